"""Neighbours, near duplicates, chat formatting, packing, mixing and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrow.llm import chat_format, mixing, near_dedup, neighbours, packing, registry
from lumenrow.llm.common import cut, join_hot
from lumenrow.llm.components import connected_components
from tests.llm.test_filters_and_scores import WORD, odd_documents

# ---- neighbours ----


def test_neighbours_equal_brute_force_on_small_tables(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype("float32")
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    x = x.astype(float)
    for q in range(0, 300, 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        due = np.lexsort((np.arange(300), far))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == due.tolist() and [r.score for r in mine] == far[due].tolist()


def test_search_takes_the_likeliest_leaves_of_all_trees():
    """As if all leaves were sorted by the sum of costs along their paths; few planes are looked at for few leaves."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 5))
    trees, q, due = [neighbours.grow(x, rng, 7) for _ in range(3)], rng.standard_normal(5), {}
    forest = neighbours.Forest(trees, [rng.integers(0, 3, t.n_leaves) for t in trees], 0.7)
    first = forest.first

    def walk(t, node, cost):
        if node < 0:
            due[int(first[t]) - node - 1] = (cost, int(forest.sizes[t][-node - 1]))
            return
        margin = (trees[t].planes[node] @ q - trees[t].offsets[node]) / 0.7
        walk(t, trees[t].kids[node][0], cost + math.log1p(math.exp(margin)))
        walk(t, trees[t].kids[node][1], cost + math.log1p(math.exp(-margin)))

    for t in range(3):
        walk(t, 0, 0.0)
    assert len(due) == first[-1]
    order = sorted((c, leaf) for leaf, (c, n) in due.items() if n)
    for enough in (1, 20, 10**6):
        taken, met = forest.search(q, enough)
        assert taken.tolist() == [leaf for _, leaf in order[: len(taken)]]
        held = np.cumsum([due[leaf][1] for leaf in taken.tolist()])
        assert (held[-1] >= enough and held[-2:-1].sum() < enough) or len(taken) == len(order)
        assert met < (600 if enough == 1 else 10**4)
    assert neighbours.Forest([neighbours.grow(x[:3], rng, 7)], [np.array([3])], 1.0).search(q, 1)[0].tolist() == [0]


def test_neighbours_recall_and_share_of_large_tables():
    """Recall of at least 0.9, and from 50,000 on about half as many products as an exact scan has, or fewer, for a query, planes too, falling."""
    rng, shares = np.random.default_rng(1), []
    for n in (2_000, 12_000, 51_000):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        sample = x[rng.permutation(n)[: neighbours.MAX_SAMPLE]]
        trees = [neighbours.grow(sample, rng, max(neighbours.LEAST_LEAF, neighbours.LEAF * len(sample) // n)) for _ in range(neighbours.TREES)]
        at = [tree.leaves(x) for tree in trees]
        forest = neighbours.Forest(trees, [np.bincount(a, minlength=t.n_leaves) for a, t in zip(at, trees, strict=True)], neighbours.SPREAD * np.sqrt(sample.var(0).mean()))
        hits, scored = [], []
        for q in range(0, n, n // 40):
            here = np.zeros(n, bool)
            leaves, met = forest.search(x[q], max(neighbours.LEAST_SEARCHED, int(neighbours.SEARCH_FACTOR * n**neighbours.SEARCH_POWER)))
            taken = set(leaves.tolist())
            for t, a in enumerate(at):
                here |= np.isin(a + forest.first[t], list(taken))
            far = ((x - x[q]) ** 2).sum(1)
            far[q] = np.inf
            hits.append(here[np.argsort(far)[:10]].mean())
            scored.append(here.mean() + met / n)
        assert np.mean(hits) >= 0.9
        shares.append(np.mean(scored))
    assert shares[2] < 0.55 and shares[2] < shares[1] < shares[0]


def brute_neighbours(rows, is_query, k=10):
    """(query, rank, id) by all distances, an id's least."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for query in sorted({i for i, _ in usable if is_query(i)}):
        best: dict[int, float] = {}
        for i, q in usable:
            for j, v in usable if i == query else []:
                if j != query and len(v) == len(q):
                    best[j] = min(best.get(j, math.inf), float(np.sqrt(((q - v) ** 2).sum())))
        out += [(query, rank, j) for rank, (_, j) in enumerate(sorted((d, j) for j, d in best.items())[:k], 1)]
    return out


def test_neighbours_query_finds_what_brute_force_finds(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    due = set(brute_neighbours(rows, lambda i: i % 100 == 0))
    got = registry.QUERIES["op2_nearest_neighbours"](spark, sf).collect()
    found, meant = {(r.query_id, r.vec_id) for r in got}, {(q, j) for q, _, j in due}
    assert len(got) == len(due) and len(found & meant) >= 0.9 * len(meant)
    vectors = {i: np.array(v, float) for i, v in rows}
    assert all(r.score == np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum()) for r in got)


def test_neighbours_in_blocks_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype("float32")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in neighbours.nearest(d, F.col("vec_id") % 100 == 0).collect()}
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 700)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 7)
    assert {tuple(r) for r in neighbours.nearest(d, F.col("vec_id") % 100 == 0).collect()} == whole


def test_neighbours_recall_with_a_third_of_the_rows_equal(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 64)).astype("float32")
    x[::3] = 0.2 * x[0]
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 300 <= 1).collect()
    hit = 0
    for q in range(1, 6000, 300):
        far = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        far[q] = np.inf
        hit += len(set(np.argsort(far, kind="stable")[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.97 * 200
    for q in range(0, 6000, 300):
        assert sorted(r.vec_id for r in got if r.query_id == q) == [i for i in range(0, 36, 3) if i != q][:10]


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, math.nan], 1), (2, [0.0, 0.0], 1), (3, None, 1), (None, [1.0, 1.0], 1), (4, [1.0, None], 1), (5, [2.0, 0.0], None), (5, [2.0, 0.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [1.0, 0.0], 2), (8, [math.inf, 0.0], 1), (5, [9.0, 0.0], 1), (200, [1.0, 1.0, 0.0], 1), (200, [9.0, 1.0], 1), (300, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(d, F.col("vec_id") % 100 == 0).collect()
    due = brute_neighbours([(i, v) for i, v, _ in rows], lambda i: i % 100 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == due
    assert due[:3] == [(0, 1, 7), (0, 2, 100), (0, 3, 5)] and {(200, 1, 5), (200, 2, 6)} <= set(due)
    assert neighbours.nearest(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)], "vec_id long, embedding array<float>")
    first = neighbours.nearest(same, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in first] == list(range(1, 11))


# ---- near duplicates ----


@pytest.mark.parametrize("shared", [0.3, 0.6, 0.9])
def test_samples_agree_as_often_as_the_weighted_similarity(shared):
    rng = np.random.default_rng(3)
    u = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    w = (1 + rng.random(len(u))).astype(np.float32)
    n = int(len(u) * shared)
    a, b = (u[: (len(u) + n) // 2], w[: (len(u) + n) // 2]), (u[(len(u) - n) // 2 :], w[(len(u) - n) // 2 :])
    x = near_dedup.WeightedSampler(1024).sample(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, len(a[0])]))
    assert (x[0] == x[1]).mean() == pytest.approx(near_dedup.weighted_jaccard(a, b), abs=0.06)


def brute_classes(texts, counts, total):
    ids, idf = near_dedup._WordIds(), near_dedup.idf_table(counts, total)
    weighed = {}
    for d, t in texts.items():
        found, times = near_dedup.shingles(near_dedup.words_of(t), ids)
        if len(found):
            weighed[d] = (found, near_dedup.weigh(found, times, idf))
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    keys = sorted(weighed)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near_dedup.weighted_jaccard(weighed[a], weighed[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def near_corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = {}
    for i in range(0, 120, 3):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))] + passage * (i % 2)
        texts[i] = " ".join(words)
        for k in (1, 2):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[i + k] = " ".join(w).upper() + "!"
    return texts


def test_near_classes_equal_brute_force(spark):
    texts = near_corpus()
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    due = brute_classes(texts, *near_dedup.document_frequencies(d))
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(d).collect()} == due
    kept = near_dedup.keep_one(d.withColumn("class_id", F.lit("x")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(due.values())) and kept.columns == ["doc_id", "text", "class_id"]


def test_near_copies_within_a_template_that_thousands_share(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(304)]
    texts, due = {}, set()
    for i in range(0, 2400, 2):
        own = [word() for _ in range(50)]
        texts[i] = " ".join(template + own)
        texts[i + 1] = " ".join(template + [word() for _ in range(50)])
        if i % 40 == 0:
            texts[i + 1] = " ".join(template + own[:21] + [word() for _ in range(29)])
            due.add((i, i + 1))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.class_id, r.doc_id) for r in near_dedup.near_classes(d).collect() if r.class_id != r.doc_id}
    assert got == due


def test_bounds_are_no_less_than_the_similarity():
    rng, ids = random.Random(2), near_dedup._WordIds()
    idf = near_dedup.idf_table(np.ones(1 << near_dedup.IDF_BITS, int), 50)
    made = []
    for n in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(5, 200))] + [f"w{k}" for k in range(n, n + 40)] + [f"v{k}" for k in range(30)]
        found, times = near_dedup.shingles(words, ids)
        made.append((found, near_dedup.weigh(found, times, idf)))
    bounds = near_dedup._bounds(made[:40], made[15:])
    exact = np.array([[near_dedup.weighted_jaccard(a, b) for b in made[15:]] for a in made[:40]])
    assert (bounds >= exact - 1e-5).all() and (exact > 0.1).any()


def test_pairs_that_share_a_long_passage_are_all_found(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(300)]
    texts = {}
    for i in range(0, 300, 2):
        own = [word() for _ in range(50)]
        texts[i], texts[i + 1] = " ".join(passage + own), " ".join(passage + own[:30] + [word() for _ in range(20)])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    due = brute_classes(texts, *near_dedup.document_frequencies(d))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(d).collect()}
    assert got == due and all(due[i + 1] == i for i in range(0, 300, 2)) and len(set(due.values())) == 150


def test_hot_keys_join_whole(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k binary, id long"))
    right = spark.createDataFrame([(b"hot", 1), (b"4", 2)], "k binary, v int")
    assert {(r.id, r.v) for r in join_hot(left, right, "k").collect()} == {(i, 1) for i in range(0, 5000, 3)} | {(4, 2)}
    assert Counter(r.v for r in join_hot(left, right, "k", "left").collect()) == Counter({1: 1667, 2: 1, None: 3333})


def test_near_odd_rows(spark):
    d = odd_documents(spark).unionByName(odd_documents(spark).filter("doc_id = 5").withColumn("doc_id", F.lit(77).cast("long")))
    classes = near_dedup.near_classes(d)
    assert classes.count() == d.count()
    got = {r.doc_id: r.class_id for r in classes.collect()}
    assert got[77] == 5 and got[0] == 0 and got[1] == 1 and got[2] == 2 and got[None] is None
    kept = near_dedup.keep_one(d)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({**{i: 1 for i in range(9)}, None: 1})
    assert near_dedup.near_classes(d.limit(0)).count() == 0 and near_dedup.keep_one(d.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_classed_by_their_texts(spark):
    words = [f"w{i}" for i in range(200)]
    one, other = " ".join(words), " ".join(reversed(words))
    near = " ".join([*words[:-1], "end"])
    rows = [(5, one, 1), (5, one, 2), (5, other, 3), (7, near, 4), (9, other.upper(), 5), (None, one, 6), (3, "", 7), (3, None, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.near_classes(d).collect()) == Counter([(5, 5)] * 3 + [(7, 5), (9, 5), (None, 5), (3, 3), (3, 3)])
    first, again = (sorted(r.n for r in near_dedup.keep_one(d.repartition(k)).collect()) for k in (1, 5))
    assert first == again and len(first) == 4 and {3, 6} <= set(first) and len({1, 2} & set(first)) == len({7, 8} & set(first)) == 1


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 44


# ---- chat ----


def test_chat_round_trip_with_odd_rows(spark):
    rows = [(1, 0, "user", "a</turn>\n### b: \\"), (1, 1, "assistant", None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (2, 0, None, "s: #"), (None, 0, "a: b", "é" * 100_000), (3, None, "assistant", "")]
    d = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_conversations(d).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 3, None: 1, 3: 1}
    digest = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", rows[0][3]), ("assistant", "")])
    assert got[2].turns_sha256 == digest([("", "s: #"), ("assistant", "x"), ("assistant", "x")]) and got[2].loss_chars == 2
    assert [got[2].formatted[a:b] for a, b in got[2].loss_spans] == ["x", "x"]
    assert chat_format.format_conversations(d.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found(spark):
    def forgetful(turns):
        return "".join(f"[{r}]{'' if r == 'assistant' and i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "long"), ("user", "r")]
    assert chat_format.locate(forgetful, turns).rewrites_at == 2
    steady = chat_format.locate(chat_format.render_marked, turns)
    assert steady.rewrites_at is None and "".join(steady.output[a:b] for a, b in steady.spans) == steady.output
    d = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(d, chat_format.Template(render=forgetful)).first()
    assert row.rewrites_at == 2 and row.turns_sha256 is None


# ---- packing ----


def test_tokenizer_equals_the_library():
    mine = packing.WordTokenizer(packing.vocabulary_path())
    rng = random.Random(2)
    texts = ["", "a\x1cb", "Σας ΣΑΣ", "İ I", "é ́x", "<|endoftext|>foo", "don't I'LL it's 123 4", "\x0bq\x0c", "'s 'S x's", "naïve Über ÿ×÷"]
    texts += ["".join(chr(rng.choice([32, 10, 0x301, 39, 115, 0x3A3, 0x41, 0xA0, 0x1D, 9, 0x30, 0x1F600, 33, 0x85, 0xE9, 0xD7])) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_plans_are_whole_gapless_and_tight(n):
    rng = np.random.default_rng(n)
    lengths = np.sort(np.minimum(4096, np.maximum(1, rng.lognormal(6.3, 1.2, n).astype(int))))
    plan = packing.pack_histogram(np.bincount(lengths, minlength=4097))
    sequence, offset = plan.look_up(lengths, np.arange(n) - np.searchsorted(lengths, lengths)) if n else (np.empty(0), np.empty(0))
    fill = Counter()
    for s, o, size in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert o == fill[s]
        fill[s] += size
    assert max(fill.values(), default=0) <= 4096 and len(fill) == plan.sequences
    assert plan.sequences <= math.ceil(lengths.sum() / 4096) * 1.02 + 2


def test_fitted_counts_are_the_least_squares_over_all_patterns():
    patterns = packing.enumerate_patterns()
    assert (patterns.sum(1) == 64).all() and len(np.unique(patterns, axis=0)) == len(patterns) and ((patterns > 0).sum(1) >= 2).all()
    histogram = np.zeros(64)
    histogram[[16, 20, 28, 32, 48, 60]] = [900, 100, 150, 600, 250, 80]
    fitted = packing.fit_counts(patterns, histogram)
    columns = np.array([np.bincount(p, minlength=64) for p in patterns], float)
    scale = 1 / np.sqrt(np.maximum(histogram, 1))
    rest = (histogram - fitted @ columns) * scale
    rest[0] = 0
    slope = (columns * scale) @ rest
    #: No pattern would gain by more of it, and none that is used by less.
    assert (fitted >= 0).all() and slope.max() < 1e-3 and np.abs(slope[fitted > 0]).max() < 1e-3 and np.count_nonzero(fitted) <= 64
    whole = packing.rounded(fitted, patterns, histogram)
    assert ((whole >= np.floor(fitted)) & (whole <= np.ceil(fitted) + 1e-6)).all()


def real_lengths(folder):
    """Piece lengths of a folder's documents."""
    import pyarrow.parquet as pq

    mine = packing.WordTokenizer(packing.vocabulary_path())
    sizes = np.array([len(mine.encode(t or "")) // 4 + 1 for t in pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist()])
    return np.concatenate([np.full((sizes // 4096).sum(), 4096), (sizes % 4096)[sizes % 4096 > 0]])


@pytest.mark.parametrize("which", ["sf0.01", "sf0.1", "five million"])
def test_patterns_pack_most_pieces_and_need_no_more_sequences_than_best_fit_alone(which):
    lengths = np.minimum(4096, np.maximum(1, np.random.default_rng(0).lognormal(6.3, 1.2, 5_000_000).astype(int))) if which == "five million" else real_lengths(f"/root/testdata/{which}")
    histogram = np.bincount(lengths, minlength=4097)
    plan = packing.pack_histogram(histogram)
    assert (np.bincount(plan.length, plan.count, 4097) == histogram).all()
    assert plan.in_patterns >= 0.85 * histogram[:4096].sum()
    rest = histogram.copy()
    rest[4096] = 0
    assert plan.sequences <= histogram[4096] + sum(n for n, _ in packing.best_fit_decreasing(rest, 4096))


def test_packing_odd_rows(spark):
    d = odd_documents(spark)
    rows = packing.pack(d).collect()
    mine = packing.WordTokenizer(packing.vocabulary_path())
    due = Counter()
    for r in d.collect():
        ids = mine.encode(r.text or "") + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            due[(r.doc_id, k, at // 4, len(ids[at : at + 16384]) // 4, zlib.crc32(ids[at : at + 16384]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == due
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert packing.pack(d.limit(0)).count() == 0


# ---- mixing ----


def fill(sizes: dict, weights=(1, 2, 3), most=3.0) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if weight[k] * share > most * sizes[k]]
        if not over:
            return target | {k: weight[k] * share for k in open_}
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
            open_.remove(k)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {k: rng.choice([0, 1, 10, 1000, 100_000]) for k in ["b", "a", "Z", "é", "", None, "c"]}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    due = fill(sizes)
    assert got.keys() == due.keys() and all(got[k] == pytest.approx(due[k]) for k in due)


def test_mixing_odd_rows(spark):
    d = odd_documents(spark)
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == d.count() and all(r.size == len(WORD.findall(r.doc.text or "")) and r.copies <= 3 for r in plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(d).collect()))
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(d.limit(0)).count() == 0


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    d = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text")).withColumnRenamed("id", "doc_id")
    rows = lambda: Counter(mixing.mix_plan(d).select("doc.doc_id", "target", "copies").collect())
    whole = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert rows() == whole and len(whole) == 4000


def test_taken_words_come_near_targets(spark):
    rng = random.Random(0)
    rows = [(i, "w " * rng.randint(1, 80), rng.choice("aaaaabc")) for i in range(6000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = plan.groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken / r.target - 1) < 0.05 for r in sums.collect())


def test_equal_rows_toss_a_coin_each(spark):
    rows = [(7, "ten words of text that all the rows have alike", "a")] * 1000 + [(i, "w " * 10, "b") for i in range(1000)] + [(None, None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(d)
    sums = {r.source: (r.taken, r.target) for r in plan.groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(sums[k][0] / sums[k][1] - 1) < 0.1 for k in "ab") and plan.count() == len(rows)
    again = mixing.mix_plan(d.repartition(7))
    assert Counter(tuple(r) for r in plan.groupBy("doc.doc_id", "copies").count().collect()) == Counter(tuple(r) for r in again.groupBy("doc.doc_id", "copies").count().collect())


# ---- queries and pipeline ----


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and registry.ORACLES.keys() <= registry.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    from tests.test_queries import TABLES, normal

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, due = normal(registry.QUERIES[name](spark, sf).toPandas()), normal(con.sql(registry.ORACLES[name]).df())
    assert got.equals(due.astype(got.dtypes.to_dict()))


def test_near_dedup_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    due = brute_classes({r.doc_id: r.text for r in docs.collect()}, *near_dedup.document_frequencies(docs))
    got = registry.QUERIES["op3_near_dedup"](spark, sf).collect()
    assert {r.doc_id: r.class_id for r in got} == due and len(got) == len(due) and all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert len(set(due.values())) < len(due)


def test_packing_query_equals_plain_steps(spark):
    sf = "/root/testdata/sf0.01"
    mine, due = packing.WordTokenizer(packing.vocabulary_path()), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = mine.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            due[(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
    rows = registry.QUERIES["op7_best_fit_packing"](spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == due
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    lengths = np.bincount([r.length for r in rows], minlength=4097)
    assert max(ends.values()) <= 4096 and len(ends) <= sum(n for n, _ in packing.best_fit_decreasing(lengths, 4096)) and len(ends) == -(-sum(r.length for r in rows) // 4096)


def test_samples_of_few_values_are_those_of_all():
    """op3: most shingles' values are not computed, and each sample is still the least of all values."""
    rng, sampler = np.random.default_rng(3), near_dedup.WeightedSampler()
    lengths = [1, 2, 30, 300, 5_000, 40, 1]
    starts = np.cumsum([0, *lengths[:-1]])
    found = np.concatenate([np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in lengths])
    weights = ((1 + np.log(rng.integers(1, 9, len(found)))) * rng.uniform(1, 1.25, len(found))).astype(np.float32)
    computed, values = [], sampler._values
    sampler._values = lambda x, log_w: computed.append(len(x)) or values(x, log_w)
    got = sampler.sample(found, weights, starts)
    assert sum(computed) < 0.3 * len(found) * near_dedup.SAMPLES
    log_w = np.log(weights).astype(np.float32)
    for k, (salt, odd) in enumerate(zip(sampler.salts, sampler.odds, strict=True)):
        x = (found ^ salt) * odd
        value, t = values(x ^ (x >> np.uint64(32)), log_w)
        at = [a + int(np.argmin(value[a : a + n])) for a, n in zip(starts, lengths, strict=True)]
        assert (got[:, k] == near_dedup._mix(found[at] + t[at].astype(np.int64).astype(np.uint64) * near_dedup._P + salt)).all()


def test_small_tables_are_in_few_parts(spark):
    """op3 and the pipeline: a hundred edges in 64 parts do not make 64 parts, and their files, in every round."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long").repartition(64)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        found = connected_components(edges)
        assert {r.root for r in found.collect()} == {0} and found.count() == 101
        assert found.rdd.getNumPartitions() <= 16
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pairs_in_many_parts_are_verified(spark):
    """op3 and the pipeline: pairs that are joined in 400 parts, each for an Arrow function, fit into a task's memory."""
    n, held = 4_000, {}
    of = lambda i: F.encode(F.lpad(i.cast("string"), 24, "0"), "utf-8")
    nodes = spark.range(2 * n).select(of(F.col("id")).alias("node"), F.unhex(F.repeat(F.lit("00000000"), near_dedup.SAMPLES)).alias("samples"), F.unhex(F.lit("01" * 8)).alias("found"), F.unhex(F.lit("0000803f")).alias("weights"))
    pairs = cut(spark.range(n).select(of(F.col("id")).alias("a"), of(F.col("id") + n).alias("b")))
    try:
        for k, v in (("spark.sql.shuffle.partitions", "400"), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
            held[k] = spark.conf.get(k)
            spark.conf.set(k, v)
        found = near_dedup.verified(pairs, cut(nodes.select("node", "samples")), cut(nodes.select("node", "found", "weights")), 0.8)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, pairs.collect()))
        assert found.rdd.getNumPartitions() <= 16
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
