"""Toxicity, quality classifier, URL filter, quality rules and secret scans: edge rows and brute force."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrow.llm import automata, quality_fm, quality_rules, registry, secret_scan, toxicity, url_filter
from lumenrow.llm.common import held_out

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD_TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 4, "x" * 200_000, "é ü ñ " * 9, "same line\nsame line\n\nsame line", "word " * 30_000]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "s", 1, 2.0, "k") for i, t in enumerate(ODD_TEXTS)] + [(None, "text of null id", None, None, None, None), (1, "", "s", 1, 2.0, "k"), (1, "", "s", 1, 2.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, score double, doc string")


# ---- automata ----


@pytest.mark.parametrize("rule", ["a(b|cd)*e?", "x{3}", "[0-9a-c]{2,}z", "\\x20*[:=]\\-", "(ab|abc)+"])
def test_automata_equal_regexes(rule):
    rng = random.Random(1)
    pattern, back, ahead = re.compile(rule.encode()), automata.backward(rule), automata.forward(rule)
    for _ in range(400):
        data = bytes(rng.choice(b"abcdexz019 :=-") for _ in range(rng.randint(0, 9)))
        ends = [e for e in range(len(data) + 1) if e and pattern.fullmatch(data, 0, e)]
        assert automata.longest(ahead, data, 0) == max(ends, default=0)
        starts = [s for s in range(len(data)) if pattern.fullmatch(data, s, len(data))]
        assert automata.leftmost(back, data, len(data), 0) == min(starts, default=None)


def test_automata_are_minimal_and_refuse_empty_matches():
    assert automata.forward("(aa|ba)").step.shape[0] == automata.forward("[ab]a").step.shape[0]
    with pytest.raises(ValueError):
        automata.forward("a*")


def marked(dfa, data):
    state, out = 0, []
    for at, byte in enumerate(data):
        state = int(dfa.step[state, dfa.classes[byte]])
        if dfa.marks[state]:
            out.append((at + 1, int(dfa.marks[state])))
    return out


@pytest.mark.parametrize("warm", [0, 2, 64])
def test_stretches_side_by_side_equal_one_walk(warm):
    rng, dfa = random.Random(4), automata.combined([("ab *c", False), ("[x-z]{3}", False), ("c(de)+f", False)])
    scanner = automata.Scanner(dfa, lanes=40, least=3, warm=warm)
    for n in (0, 1, 2, 50, 900):
        for letters in (b"abc dexyzf", b"ab c", b"   ab", b"de", b"x"):
            data = bytes(rng.choice(letters) for _ in range(n))
            data = data[: n // 2] + b"ab" + b" " * (n // 3) + data[n // 2 :] + b"c"
            ends, marks = scanner.scan(np.frombuffer(data, np.uint8))
            assert list(zip(ends.tolist(), marks.tolist(), strict=True)) == marked(dfa, data)


# ---- secrets ----

_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", data) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", data) if m.end() - m.start() >= 24])


def test_secret_spans_equal_regexes():
    rng = random.Random(3)
    parts = ["password", "PassWd", "token", "api_key", "AKIA", "'", '"', " ", ":", "=", "abc", "deadbeef" * 3, "ABCDEFGHIJKLMNOPQRST", "é", "\n", ",", ".", "-", "tokentoken"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))).encode() for _ in range(3000)]
    for text, found in zip(texts, secret_scan.SecretScanner().scan(texts), strict=True):
        assert [x for x in found if x[1] < 3] == base_spans(text)


def test_long_lines_are_scanned_in_stretches():
    import time

    words = " ".join(f"some words number {i} and no break at all" for i in range(60_000)).encode()
    text = words + b" password" + b" " * 300_000 + b"= secret99 " + words
    scanner, began = secret_scan.SecretScanner(), time.perf_counter()
    found = scanner.scan([text])[0]
    assert [x for x in found if x[1] < 3] == base_spans(text) and len(base_spans(text)) == 1
    assert time.perf_counter() - began < 5


def test_secret_columns(spark):
    text = "é password=abcdef1 and ghp_" + "Z" * 36 + " token = \"0123456789abcdef01234567\""
    d = odd_documents(spark).unionByName(spark.createDataFrame([(99, text)], "doc_id long, text string"), allowMissingColumns=True)
    got = secret_scan.scan_secrets(d)
    assert got.count() == d.count() and got.filter("doc.doc_id <> 99 and size(spans) > 0").count() == 0
    row = got.filter("doc.doc_id = 99").first()
    assert [(s.kind, text[s.start : s.end][:8]) for s in row.spans] == [("assign", "password"), ("github", "ghp_ZZZZ"), ("assign", "token = "), ("hex", "01234567")]
    assert row.redacted == 'é [assign] and [github] [assign]"'
    assert secret_scan.scan_secrets(d.limit(0)).count() == 0


def test_private_keys_are_redacted_whole(spark):
    body = "\n".join("MIIEow+/" * 8 for _ in range(4)) + "\nabc=="
    key = lambda kind: f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
    ciphered = f"-----BEGIN RSA PRIVATE KEY-----\nDEK-Info: AES-128-CBC,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    texts = {f"é {key('RSA ')} between {key('')} after": "é [pem] between [pem] after", ciphered: "[pem]", key("").replace("\n", "\r\n"): "[pem]", key("").replace("\n", "\\n") + "!": "[pem]!"}
    texts |= {"-----BEGIN PRIVATE KEY-----\n" + "A" * 64 + "\nthe end": "[pem]\nthe end", "a -----BEGIN PRIVATE KEY----- line, and -----BEGIN CERTIFICATE-----": "a [pem] line, and -----BEGIN CERTIFICATE-----"}
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.doc.text: r.redacted for r in secret_scan.scan_secrets(d).collect()} == texts


# ---- quality rules ----


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + [" ".join(rng.choice("ab") + rng.choice(["", "\n", "#"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in d.select("doc_id", quality_rules.text_statistics(F.col("text")).alias("s")).collect():
        s = r.s
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_statistics(texts[r.doc_id]), r.doc_id


def test_rules_are_learned_and_judged(spark):
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 4] < 0.5)
    rules = quality_rules.learn_rules(x, bad)
    found = {(n, a) for r in rules for n, a, _ in r.terms}
    assert ("symbol_share", True) in found and ("repeat_share", False) in found
    assert quality_rules.learn_rules(x, np.zeros(900, bool)) == [] and quality_rules.learn_rules(x[:0], bad[:0]) == []
    d = odd_documents(spark)
    got = quality_rules.judge(d, rules)
    assert got.count() == d.count() and got.filter("kept and base_failed").count() == 0
    assert got.select("doc.*").columns == d.columns
    assert quality_rules.judge(d.limit(0), rules).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    assert quality_rules.fit(d, labels) == [] and quality_rules.fit(d, labels.limit(0)) == []


# ---- URLs ----


def test_urls(spark):
    rows = [(1, None), (2, "x"), (3, "HTTP://A.NET"), (4, "http://a.NET/"), (5, "b://q.example.net/en/é?x://"), (6, "://"), (7, "x\ny://Foo.org/fr/"), (8, "://xnet/"), (9, "h://example.com/de/1"), (9, "h://example.com/de/1"), (None, "h://example.net/en"), (10, "h://a/" + "p" * 50_000)]
    p = spark.createDataFrame([(*r, "h", "v", 1) for r in rows], "page_id long, url string, host string, verdict string, n int")
    got = {r.page.page_id: r for r in url_filter.judge_urls(p).collect()}
    assert url_filter.judge_urls(p).count() == len(rows)
    due = {1: ("", "", None), 2: ("", "", None), 3: ("a.net", "", None), 4: ("a.net", "/", "net/"), 5: ("q.example.net", "/en/é", "example.net/en/"), 6: ("", "", None), 7: ("foo.org", "/fr/", "org/fr/"), 8: ("xnet", "/", None), 9: ("example.com", "/de/1", "example.com/de/"), None: ("example.net", "/en", "net/")}
    for key, (host, path, rule) in due.items():
        assert (got[key].host, got[key].path, got[key].rule) == (host, path, rule)
    assert got[4].verdict == "block" and got[7].verdict == "allow" and got[1].verdict in ("allow", "block")
    assert url_filter.judge_urls(p.limit(0)).count() == 0


def test_url_model_equals_brute_force(spark):
    keys = [("ab/", "allow", 3), ("ba?x=12", "block", 2), ("abç", None, 1), ("", "allow", 1)]
    d = spark.createDataFrame(keys, "key string, verdict string, n int").select("verdict", "n", F.explode(url_filter._grams(F.col("key"))).alias("gram"))
    got = {r.gram: r.ratio for r in url_filter.gram_ratios(d).collect()}
    symbols = url_filter.ALPHABET + "^$"
    number = lambda gram: sum(symbols.index(c) * url_filter.SYMBOLS ** (3 - i) for i, c in enumerate(gram))
    grams = {v: defaultdict(float) for v in ("allow", "block", None)}
    for key, v, n in keys:
        text = "^^^" + key.replace("ç", "?").replace("1", "0").replace("2", "0") + "$"
        for i in range(len(text) - 3):
            grams[v][text[i : i + 4]] += n

    def p(v, gram):
        out = 1 / url_filter.SYMBOLS
        for order in range(4):
            part = gram[3 - order :]
            seen = sum(n for g, n in grams[v].items() if g[3 - order :] == part)
            context = sum(n for g, n in grams[v].items() if g[3 - order : 3] == part[:-1])
            out = (seen + url_filter.PRIOR * out) / (context + url_filter.PRIOR)
        return out

    every = {g for counts in grams.values() for g in counts}
    assert got.keys() == {number(g) for g in every}
    for gram in every:
        assert got[number(gram)] == pytest.approx(math.log(p("allow", gram) / p("block", gram)))


def test_urls_are_scored_whole(spark):
    rows = [(i, f"http://a{i}.example.net/{'en' if i % 2 else 'x'}/{i}?{'good' if i % 2 else 'poor'}=1") for i in range(60)] + [(100, "http://q.example.com/1?good=1"), (101, "http://q.example.com/1?poor=1")] + [(200 + i, None) for i in range(900)]
    p = spark.createDataFrame(rows, "page_id long, url string").withColumn("map", F.create_map(F.lit("k"), F.col("url")))
    got = {r.page.page_id: r for r in url_filter.judge_urls(p).collect()}
    assert len(got) == len(rows) and got[100].score > got[101].score and got[1].score > got[2].score
    assert {r.verdict for r in got.values() if r.page.url is None} in ({"allow"}, {"block"})


# ---- toxicity ----


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lexicon_automaton_equals_edit_distance():
    rng = random.Random(2)
    words, stems = ["moron", "idiot", "scum", "abcabc", "abd"], ["vequ", "mor"]
    machine = toxicity.LexiconAutomaton(words, stems, {"moron", "idiot", "scum", "abd", "vequ*"})
    for _ in range(4000):
        w = list(rng.choice([*words, "vequ", "vequxyz", "other", "morxx"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "m", "q"])
        w = "".join(w)
        exact = {x for x in words if x == w} | {x + "*" for x in stems if w.startswith(x)}
        near = {x for x in ("moron", "idiot", "scum") if edits(w, x) == 1}
        near |= {"vequ*"} if "vequ*" not in exact and any(edits(w[:n], "vequ") <= 1 for n in range(len(w) + 1)) else set()
        assert tuple(map(set, machine.match(w))) == (exact, near), w


def toxic_corpus(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = [rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[7], words[20] = "blockhead", "nitwit"
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_and_tells_quotation(spark):
    d = toxic_corpus(spark)
    model = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"), 5, 0)))
    assert {"blockhead", "nitwit"} <= model.words.keys()
    assert model.score("you blockhead and nitwit") > 0.9 > 0.5 > model.score("lorem ipsum") and model.score("you blokhead, nitwitt") > model.score("lorem ipsum")
    assert model.score("he said \"blockhead\" once") < model.score("sit blockhead once")
    scored = odd_documents(spark).select("*", toxicity.toxicity(model)(F.col("text")).alias("out"))
    assert scored.count() == 12 and scored.filter("not out between 0 and 1").count() == 0
    assert len({r.out for r in scored.filter("text is null or text = ''").collect()}) == 1


def test_toxicity_without_both_labels(spark):
    d = toxic_corpus(spark).withColumn("toxic", F.lit(0))
    model = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert 0 < model.score("blockhead") < 0.5
    assert toxicity.fit(d.limit(0), d.limit(0)).score(None) == pytest.approx(0.5)


# ---- factorisation machine ----


def test_pairwise_sum_equals_double_loop():
    rng = np.random.default_rng(1)
    machine = quality_fm.FactorisationMachine(0.3, rng.standard_normal(quality_fm.WIDTH), rng.standard_normal((quality_fm.WIDTH, quality_fm.FACTORS)))
    index, value = np.array([3, 50, 700, 9]), np.array([0.5, 1.0, 2.0, 0.1])
    due = 0.3 + (machine.linear[index] * value).sum() + sum(machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert machine.margins(index, value, np.array([0]))[0] == pytest.approx(due)


def test_machine_learns_structure_and_metadata(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, "*** ".join(words) if bad else " ".join(words), 240, 0 if bad else 1))
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, quality int")
    scored = lambda d, machine: d.select("quality", quality_fm.quality(machine)(F.col("text"), F.col("n_chars")).alias("s")).collect()
    machine = quality_fm.fit(d.drop("quality").unionByName(d.drop("quality").filter("doc_id < 9")), d.select("doc_id", "quality"))
    assert sum((r.s >= 0.5) == (r.quality == 1) for r in scored(d, machine)) >= 0.97 * 300
    told = d.withColumn("text", F.lit("all alike")).withColumn("n_chars", F.when(F.col("quality") == 0, 3).when(F.col("doc_id") % 2 == 0, 3000))
    assert sum((r.s >= 0.5) == (r.quality == 1) for r in scored(told, quality_fm.fit(told, told))) == 300
    odd = odd_documents(spark).withColumn("n_chars", F.col("size")).withColumn("quality", F.lit(1))
    assert len(scored(odd, machine)) == 12 and all(0 <= r.s <= 1 for r in scored(odd, machine)) and scored(odd.limit(0), machine) == []
    assert quality_fm.fit(d.limit(0), d.limit(0)).scores(["x"])[0] == pytest.approx(0.5)


# ---- registered queries ----


def auc(rows, known):
    good, bad = ([r.score for r in rows if known[r.doc_id] == y] for y in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "folds", "fold", "table", "least"), [("op1_toxicity", "toxic", 5, 0, "sf0.1", 0.95), ("op5_quality_classifier", "quality", 3, 1, "sf0.01", 0.98)])
def test_classifier_query_is_good_on_held_out_labels(spark, name, label, folds, fold, table, least):


    sf = f"/root/testdata/{table}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.QUERIES[name](spark, sf).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    known = {r.doc_id: r[label] for r in labels.select("doc_id", label).dropna().collect()}
    rows = [r for r in got if r.held_out and r.doc_id in known]
    assert len(rows) >= 50 and auc(rows, known) >= least
    assert Counter(got) == Counter(registry.QUERIES[name](spark, sf).collect())


def test_secret_query_equals_regexes(spark):

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.QUERIES["op10_secret_scan"](spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        spans = [(len(data[:a].decode()), len(data[:b].decode()), ("assign", "access", "hex")[k]) for a, k, b in base_spans(data)]
        joined = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in spans) for x in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for a, b, k in spans} <= set(r.spans.split(","))


def test_rules_query_equals_brute_force(spark, sf):
    """Counts and base test by a plain walk, and verdicts by the learned rules applied to these counts."""

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, rules = {r.doc_id: r.text for r in docs.collect()}, quality_rules.fit(docs, labels)
    got = registry.QUERIES["op9_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts) and {r.kept for r in got} == {True, False}
    for r in got:
        text = texts[r.doc_id] or ""
        n, chars, symbols, dup, repeat = brute_statistics(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        share = lambda a, b: a / b if b else 0.0
        values = dict(zip(quality_rules.FEATURES, (n, share(chars, n), share(symbols, n), share(dup, len(lines)), share(repeat, n), share(len(set(words)), n), share(sum(c.isupper() and unicodedata.category(c) == "Lu" for c in text), chars), share(text.count("!"), n)), strict=True))
        failed = n < 20 or 100 * repeat > 30 * n
        rejected = any(all(values[f] >= t if at_least else values[f] <= t for f, at_least, t in rule.terms) for rule in rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected)


def within_an_edit(a, b):
    """Plain recursion: whether one insertion, deletion or substitution at most makes ``a`` ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i:] == b[i:] or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_toxicity(model, text, known):
    """The score of a whole text, with every word held against every entry of the lexicon."""
    odds_of = model.entries

    def code(word):
        if word in model.words:
            return model.words[word]
        if stems := [s for s in model.stems if word.startswith(s)]:
            return model.stems[max(stems, key=len)]
        if word in model.clean_words:
            return 0.0
        near = [e for e in model.pure if (within_an_edit(e, word) if not e.endswith("*") else any(within_an_edit(e[:-1], word[:n]) for n in range(len(e) - 2, len(e) + 1) if n <= len(word)))]
        return -model.loose.get(max(near, key=lambda e: (odds_of[e], e)), toxicity.TRACE) if near else 0.0

    words, times, sums = toxicity.tokens(text), Counter(), [0.0, 0.0, 0.0]
    for at, word in enumerate(words):
        found = known[word] if word in known else known.setdefault(word, code(word))
        if not found:
            continue
        times[word] += 1
        share, weight = toxicity.quotation(words, at), abs(found) / times[word]
        sums = [sums[0] + (1 - share) * weight, sums[1] + share * weight, sums[2] + (1 - share) * weight * (abs(found) >= toxicity.PURE)]
    sums.append(100 * sums[0] / (len(words) + 100))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, model.weights[0] + sum(w * math.log1p(x) for w, x in zip(model.weights[1:], sums, strict=True))))))


def test_toxicity_query_equals_a_plain_rescoring_of_whole_texts(spark):
    folder, known = "/root/testdata/sf0.01", {}
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"), 5, 0)))
    got = {r.doc_id: r.score for r in registry.QUERIES["op1_toxicity"](spark, folder).collect()}
    due = {r.doc_id: plain_toxicity(model, r.text, known) for r in docs.select("doc_id", "text").collect()}
    assert len(model.pure) >= 3 and sum(x < 0 for x in known.values()) >= 1
    assert got == pytest.approx(due, abs=1e-9)


def test_quality_query_equals_a_plain_rescoring_of_whole_texts(spark, sf):
    """Every pair of features of every text, one by one."""
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    machine = quality_fm.fit(docs, labels.select("doc_id", "quality").filter(~held_out(F.col("doc_id"), 3, 1)))
    got = {r.doc_id: r.score for r in registry.QUERIES["op5_quality_classifier"](spark, sf).collect()}
    for r in docs.collect():
        words = sorted(set((r.text or "").split()))
        index = [zlib.crc32(w.encode()) % quality_fm.WORD_BUCKETS for w in words] + quality_fm.statistics_of(r.text or "", (r.text or "").split(), len(words), r.n_chars)
        value = np.array([1 / math.sqrt(len(words))] * len(words) + [1.0] * len(quality_fm.STATISTICS))
        v = machine.factors[index].astype(float) * value[:, None]
        pairs = np.triu(v @ v.T, 1).sum()
        z = machine.bias + float(machine.linear[index].astype(float) @ value) + pairs
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), abs=1e-4), r.doc_id
