"""Training-data operators against brute force, on small rows with nulls, empty and long texts, ties,
repeated rows and extra columns."""

import collections
import hashlib
import math
import random
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skuforge.llm import contamination, edit_counts, langid, licences, near, pieces, quality, recompress, simhash, surrogates, warc
from skuforge.plans.results import shared_folder

RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randrange(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(70, "passage")
TEXTS = [
    None, "", " \t\n", "one", "A b", prose(49, 1), prose(50, 2), prose(300, 3), prose(300, 3), prose(300, 3) + " tail words here",
    "lead " + PASSAGE + " tail", prose(40, 4) + "\n" + PASSAGE + "\x0b" + prose(60, 5), PASSAGE, "same " * 200, "same " * 120 + PASSAGE, prose(4000, 6),
    prose(2000, 6), "x" * 5000 + " " + PASSAGE, "line one is here\nline one is here\n\nline two ### *** |", prose(12, 7), "É ü " + prose(80, 8),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, prose(300, 3)), (3, prose(60, 9)), (40, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "u", 1.5) for i, t in ROWS], "doc_id long, text string, name string, shard double").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def brute_repeats(rows, size=50):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - size + 1):
                key = tuple(w[p:p + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p:p + size])] < i:
                gone.update(range(p, p + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(docs):
    got = [tuple(r) for r in recompress.remove_repeats(docs, keep_text=False).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repeats(ROWS)))
    text = {r["doc_id"]: r["kept_text"] for r in recompress.remove_repeats(docs.where("doc_id = 12 or doc_id = 10")).collect()}
    assert text == {10: "lead " + PASSAGE + " tail", 12: ""}


def test_repeats_of_random_edits(spark):
    rows, r = [], random.Random(8)
    for i in range(60):
        w = prose(260, i % 4).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w[r.randrange(100):])))
    got = [tuple(x) for x in recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()]
    assert sorted(got) == sorted(brute_repeats(rows))


def test_boundaries_of_equal_passages_agree():
    alpha = recompress.reach(recompress.LEVELS)
    h = np.array([hash(w) & (2**64 - 1) for w in (prose(30, 1) + " " + PASSAGE + " " + prose(9, 2) + " " + PASSAGE).split()], np.uint64)
    b = recompress.boundaries(h, np.array([0, len(h)]))
    assert (b[30 + alpha:100 - alpha] == b[109 + alpha:179 - alpha]).all()


def test_no_rows(nothing, spark):
    assert recompress.remove_repeats(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.report(nothing, items).count() == 0
    assert surrogates.pseudonymised(nothing).count() == 0
    assert pieces.digests(nothing).count() == 0
    assert edit_counts.recount(nothing).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(nothing, labels).count() == 0
    assert near.near_duplicates(nothing.select("doc_id", F.lit("").alias("text_key"), "text")).count() == 0
    model = langid.train(nothing.withColumn("lang", F.lit("en")))
    assert langid.identify(nothing, model).count() == 0


def test_simhash_components(docs):
    rows = [(i, simhash.fingerprint((t or "").encode())) for i, t in ROWS]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    assert got == sorted((i is None, i or 0, f, least[find(f)]) for i, f in rows)
    assert simhash.fingerprint(b"") == 0


def test_tree_finds_every_pair_and_blocks_keep_links(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 150, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 63, 150, dtype=np.uint64)) for _ in range(6)])
    fps = np.unique(np.concatenate([base, near]))
    points = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(points, 3, shard_points=20, sample_points=300)
    roots = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    parent = np.arange(len(fps))
    p, q = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    simhash.unite(parent, p, q)
    groups = collections.defaultdict(set)
    for x, k in zip(fps.view(np.int64).tolist(), parent.tolist()):
        groups[k].add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def brute_similar(texts):
    """Of each text the first text of its component of Jaccard similarities >= 0.8 of five-word shingles."""
    split = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in split]
    parent = np.arange(len(texts))
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if 5 * shared >= 4 * (len(x) + len(sets[j]) - shared):
                simhash.unite(parent, np.array([i]), np.array([j]))
    return parent.tolist()


def edited_copies():
    r, texts = random.Random(12), [None, "", "one two", "One  two", prose(49, 1)]
    for k in range(25):
        base = prose(r.randrange(30, 400), f"base{k}").split()
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(len(w) // 16)):
                w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    return texts


def test_near_stage_drops_edited_copies_and_no_other(spark):
    import corpus_pipeline

    texts = edited_copies()
    first = brute_similar(texts)
    fps = np.array([simhash.fingerprint((t or "").encode()) & (2**64 - 1) for t in texts], np.uint64)
    assert sum(f != i and int(np.bitwise_count(fps[i] ^ fps[f])) > 3 for i, f in enumerate(first)) > 5  # what three bits leave
    frame = spark.createDataFrame([(i, t, f"row {i}") for i, t in enumerate(texts)] + [(None, texts[9], "no id")], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, frame, None)
    assert got.columns == frame.columns
    want = [(i, texts[i], f"row {i}") for i, f in enumerate(first) if i == f] + [(None, texts[9], "no id")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_template_pages_are_no_candidates(spark, monkeypatch):
    """Pages of 100 equal and 18 own words each stay below the similarity; candidates grow with the pages, not their square."""
    seen = {}
    kept = near.written
    monkeypatch.setattr(near, "written", lambda df, name: seen.setdefault(name, kept(df, name)))
    rows = [(i, str(i), prose(100, 1) + " " + " ".join(f"w{i}x{k}" for k in range(18))) for i in range(300)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text_key string, text string")).collect()
    assert all(r["first"]["doc_id"] == r["doc_id"] for r in found) and len(found) == 300
    assert seen["near-stars"].count() + seen["near-rest"].count() <= 300


def test_bounds_of_similar_sets_never_reject():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(-2**62, 2**62, n))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.integers(-2**62, 2**62, int(r.integers(0, n // 8 + 1)))]))
        assert near.apart(near.parity(x), near.parity(y)) <= len(np.setxor1d(x, y))
    assert near.apart(near.parity(x), near.parity(x)) == 0


def test_near_stage_clashing_columns_and_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, prose(60, 1), "a", 7), (1, prose(60, 1), "a", 7), (1, prose(60, 1), "b", 7), (2, prose(60, 1), "c", 8), (3, prose(60, 2), "d", 9), (None, prose(60, 1), "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, copies int")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert len(got) == 3 and (3, prose(60, 2), "d", 9) in got and (None, prose(60, 1), "e", 1) in got
    assert [r[3] for r in got if r[0] == 1] == [7]


def test_near_stage_keeps_distinct_texts_of_one_id(spark):
    import corpus_pipeline

    a, b, c = prose(60, "a"), prose(60, "b"), prose(60, "c")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, c, "x"), (5, c, "x"), (7, b, "x"), (5, c, "y")]
    for n in (1, 5):
        got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), None).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, a), (5, b), (5, c)])


def test_contamination_blocks_and_short_items(spark, docs):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[:4])), (10, prose(30, 3)), (3, None), (None, "one"), (4, "..."), (5, "ONE"), (10, prose(30, 3))]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = contamination.item_words(t)
        if i is not None and w:
            for p in range(max(1, len(w) - 9)):
                windows[tuple(w[p:p + 10])].add(str(i))
    want = []
    for i, t in ROWS:
        w, hit, who = contamination.item_words(t), set(), set()
        for m in {len(x) for x in windows}:
            for p in range(len(w) - m + 1):
                if tuple(w[p:p + m]) in windows:
                    hit.update(range(p, p + m))
                    who |= windows[tuple(w[p:p + m])]
        want.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    for block in (10**6, 60):
        found = contamination.matches(docs.select("doc_id", "text"), frame, block_words=block)
        got = [(r["doc_id"], r["match"]["n_words"], contamination.covered(r["match"]["ranges"]), len(r["match"]["item_ids"])) for r in found.collect()]
        assert sorted(map(repr, got)) == sorted(repr(w[:4]) for w in want)
    assert sorted(map(repr, map(tuple, contamination.report(docs, frame).collect()))) == sorted(map(repr, want))
    clean = contamination.decontaminate(docs, frame)
    assert clean.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert 12 not in kept and kept[11] == prose(40, 4) + "\n\x0b" + prose(60, 5) and kept[0] is None


def test_quality_base_figures_and_verdict(spark, docs):
    labels = spark.createDataFrame([(15, 1, 0), (16, 1, 0), (16, 0, 0), (13, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels)
    assert set(docs.columns) < set(got.columns)
    for r in got.collect():
        t, q = r["text"] or "", r["quality"]
        w = t.encode().split()
        seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        inside = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (
            len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert q["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert q["kept"] == (not q["base_failed"] and q["llr"] >= quality.THRESHOLD and q["n_severe"] < quality.SEVERE)


def test_quality_ratios_match_brute_force(spark):
    insult = " you total clown and utter clown "
    rows = [(i, prose(60, i) + (insult if i % 10 == 0 else "")) for i in range(900)] + [(900, prose(40, 1) + insult), (901, None), (902, prose(40, 2))]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(900) if i % 3], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, i, "x", "y") for i, t in rows], "doc_id long, text string, quality int, _figures string, _ratios string")
    got = quality.judged(docs, labels, name="verdict")
    assert got.columns == [*docs.columns, "verdict"]
    seed = lambda data, s=42: xxhash.xxh64_intdigest(data, s)

    def grams(t):
        w = (t or "").encode().split()
        return [x - (1 << 64) if x >> 63 else x for x in [seed(a) for a in w] + [seed(b, seed(a)) for a, b in zip(w, w[1:])]]

    trusted = {i for i in range(900) if i % 3 and i % 10}
    raw, hit = collections.Counter(), collections.Counter()
    for i, t in rows:
        for g in set(grams(t)):
            raw[g % quality.MOST_BUCKETS] += 1
            hit[g % quality.MOST_BUCKETS] += i in trusted
    buckets = min(quality.MOST_BUCKETS, max(quality.PART, 1 << (4 * len(raw)).bit_length()))
    raw2, hit2 = collections.Counter(), collections.Counter()
    for k, n in raw.items():
        raw2[k % buckets] += n
        hit2[k % buckets] += hit[k]
    share = sum(hit.values()) / sum(raw.values())
    for r in got.collect():
        ratios = [math.log((hit2[g % buckets] + quality.PRIOR) / (raw2[g % buckets] * share + quality.PRIOR)) for g in grams(r["text"])]
        assert r["verdict"]["llr"] == pytest.approx(sum(ratios) / len(ratios) if ratios else 0, abs=1e-5)
        assert r["verdict"]["n_severe"] == sum(x < quality.SEVERE_RATIO for x in ratios)
        assert r["quality"] == r["doc_id"] and (r["_figures"], r["_ratios"]) == ("x", "y")
    kept = {r["doc_id"] for r in got.where("verdict.kept").collect()}
    assert 900 not in kept and 902 in kept and not {i for i in range(900) if i % 10 == 0} & kept


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    found = quality.judged(docs.select("doc_id", "text"), labels.where(~odd)).where("not quality.base_failed").select("doc_id", "quality.kept", "text")
    abuse = F.col("text").rlike(r"(?i)\b(idiot|trash|moron|scum|loser|clown|stupid|worthless|pathetic|disgusting)\b")
    rows = found.join(labels.where(odd), "doc_id").groupBy((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), abuse.alias("abuse")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {(r["good"], r["toxic"], r["abuse"]): r["kept"] for r in rows}
    assert kept[True, False, False] > 0.99 and kept[True, True, True] < 0.1 and kept[False, False, False] < 0.1


def test_quality_without_labels_rejects_by_base_rules_alone(spark, docs):
    got = quality.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.where("quality.kept = quality.base_failed or quality.llr <> 0").count() == 0


def test_languages_spans_and_scripts(spark):
    en, el = "the house of the sea and the land ", "το σπίτι και η θάλασσα "
    de = "das haus und die see mit dem land "
    rows = [(i, en * 8, "en") for i in range(20)] + [(i + 20, de * 8, "de") for i in range(20)] + [(i + 40, el * 8, "el") for i in range(20)] + [(99, en, None), (98, None, "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "el", "en"]
    probe = spark.createDataFrame([(1, en * 6 + de * 9), (2, el), (3, None), (4, "123 ..."), (5, ""), (6, de), (7, "語語"), (8, "½ ² Ⅷ ①")], "id long, text string")
    got = {r["id"]: r["language"] for r in langid.identify(probe, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and got[1]["spans"][0]["end"] == 48 and got[1]["lang"] == "de"
    assert (got[2]["lang"], got[6]["lang"]) == ("el", "de") and {got[k]["lang"] for k in (3, 4, 5, 8)} == {"und"} and got[7]["lang"] in model.langs


def test_viterbi_shortcut_is_exact():
    r = np.random.default_rng(3)
    for _ in range(60):
        s = -np.abs(r.normal(0, 5, (40, 3)))
        best = np.zeros(3) + s[0]
        for row in s[1:]:
            best = row + np.maximum(best, best.max() - 12)
        path = langid.label(s, 12)
        assert abs(s[np.arange(40), path].sum() - 12 * (path[1:] != path[:-1]).sum() - best.max()) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3_script_viterbi_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97


def test_pieces_samples_are_distinct_exact_and_reproducible(spark, docs):
    rows = pieces.encode(docs).collect()
    text = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert text == collections.Counter(ROWS)
    for r in rows:
        ids = [tuple(s["ids"]) for s in r["samples"]]
        assert len(set(ids)) == len(ids) and all(pieces.decode(x) == (r["text"] or "") for x in [r["best"], *ids])
        assert all(s["log_inclusion"] <= 0 for s in r["samples"])
    again = pieces.digests(docs.repartition(1)).collect()
    assert {(r["doc_id"], str(r["samples"])) for r in again} == {(r["doc_id"], str(r["samples"])) for r in pieces.digests(docs).collect()}
    assert all(r["round_trip"] for r in again)


def test_gumbel_top_k_has_the_exact_distribution():
    t, n = "ab▁c\n", 4000
    p = pieces.pieces(pieces.MODEL_FILE)
    got = pieces.encode_texts([t] * n, pieces.mix(np.arange(n, dtype=np.uint64)), 3, pieces.MODEL_FILE)
    prob = {tuple(s["ids"].tolist()): np.exp(s["log_prob"]) for g in got for s in g["samples"]}
    first = collections.Counter(tuple(g["samples"][0]["ids"].tolist()) for g in got)
    second = collections.Counter(tuple(g["samples"][1]["ids"].tolist()) for g in got)
    assert abs(sum(prob.values()) - 1) < 1e-6
    for k, v in prob.items():
        assert abs(first[k] / n - v) < 0.03
        assert abs(second[k] / n - sum(prob[a] * v / (1 - prob[a]) for a in prob if a != k)) < 0.03
    assert p.text[int(got[0]["best"][-1])] == "<0x0A>"


def test_warc_rejects_magic_in_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "x" * 50000 + inner + "y" * 70000), (2, "v", None), (3, "a\r\nb", ""), (4, None, inner * 3), (5, "w", "x" * 30000 + "WARC/1.1\r\n" * 900),
            (6, "w", inner * 3), (None, "w", "nul"), (7, "k", "WARC/1.1\r\n"), (2, "v", "again")] + [(10 + i, "m", f"é{i}" * 1000) for i in range(60)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        path = f"{shared_folder(spark)}/warc-test-{uuid.uuid4().hex}"
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
        got = warc.read_archives(spark, path, with_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = collections.Counter((r["record_id"], r["payload_bytes"], r["record_type"]) for r in got)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert found == collections.Counter(("urn:page:" + ("none" if i is None else str(i)), len((h or "").encode()), "response" if i is None or first[h or ""] == i else "revisit") for i, _, h in rows)
    body = {r["record_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert body["urn:page:1"] == rows[0][2] and body["urn:page:5"] == rows[4][2] and all(r["payload_digest"] == r["declared_digest"] for r in got)


def test_surrogates_are_consistent_distinct_and_keep_the_form(spark):
    many = " ".join(f"{c}@x.de" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(1, "Mail jo.19@mail5.example.com, +1 (521) 555-6210, card 4111 1111 1111 1111."), (2, 'Mrs Anna Smith, Herr MÜLLER, госпожа Анна Петрова, jo.19@mail5.example.com, token "' + "ab" * 20 + '"'),
            (3, None), (4, ""), (5, "1.2.3.4 and 1.2.3.4.5"), (6, many), (6, "plain")]
    frame = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, row int")
    got = collections.defaultdict(list)
    for r in surrogates.pseudonymised(frame).collect():
        got[r["doc_id"]].append(r["text"])
        assert r["row"] == r["doc_id"]
    assert got[3] == [None] and got[4] == [""] and "plain" in got[6]
    one, two = got[1][0], got[2][0]
    mail = one.split()[1].strip(",")
    assert mail != "jo.19@mail5.example.com" and mail in two and "555-6210" not in one and "4111" not in one
    card = [int(c) for c in one.split("card ")[1] if c.isdigit()]
    assert len(card) == 16 and sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(card))) % 10 == 0
    assert any(f"Mrs {n} " in two for n in surrogates.NAMES["latin", "female"]) and any(f"госпожа {n} " in two for n in surrogates.NAMES["cyrillic", "female"]) and "MÜLLER" not in two
    new = [x for x in got[6] if x != "plain"][0].split()
    assert len(set(new)) == 26 and not set(new) & set(many.split())
    assert "1.2.3.4 " not in got[5][0] and got[5][0].endswith("1.2.3.4.5")


def test_secrets_of_either_case_go(spark):
    lower, mixed = "9233a8ec0f" * 4, "9233A8ecfb" * 4
    rows = [(1, f'token = "{lower}"'), (2, f'TOKEN = "{lower.upper()}"'), (3, f"key {mixed} end"), (4, "KEY " + "ABCDEF" * 6), (5, "A" * 31 + " " + "F" * 65 + " G" + "A" * 32)]
    got = {r["doc_id"]: r for r in surrogates.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_entities"] for k in (1, 2, 3, 4, 5)] == [1, 1, 1, 1, 0] and got[5]["text"] == rows[4][1]
    new = [got[1]["text"][9:-1], got[2]["text"][9:-1], got[3]["text"].split()[1], got[4]["text"][4:]]
    assert [len(x) for x in new] == [40, 40, 40, 36] and all(int(x, 16) >= 0 for x in new)
    assert len({x.lower() for x in [*new, lower, mixed, "ABCDEF" * 6]}) == 7
    assert new[0] == new[0].lower() and new[1] == new[1].upper() and new[3] == new[3].upper()
    assert all(c == c.upper() if o in "ABCDEF" else c == c.lower() for c, o in zip(new[2], mixed))


def test_licences_known_unknown_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    fitted = licences.model(docs)
    probe = [(k, t) for k, ts in licences.TEMPLATES.items() for t in ts] + [("none", t) for t in licences.HARD_NEGATIVES] + [("none", None), ("none", ""), ("none", "Licensed under the Foo Public License, version 9.")]
    frame = spark.createDataFrame([(k, None if t is None else "A line.\n" + t) for k, t in probe], "want string, text string")
    for r in licences.scan(frame, fitted).collect():
        families = {x["family"] for x in r["licences"]} - {licences.UNKNOWN}
        marked = any(m in (r["text"] or "").lower() for m in licences.MARKERS)
        assert families == ({r["want"]} if r["want"] != "none" and marked else set()), r


def test_licences_short_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    fitted = licences.model(docs)
    probe = [(k, t) for k, ts in licences.SHORT_FORMS.items() for t in ts] + [("gpl", "# GPLv3")]
    probe += [("none", "All rights of the tenants are reserved for later."), ("none", "We met at the station and all went well."), ("none", prose(60, 3) + " GPLv3 " + prose(60, 4))]
    frame = spark.createDataFrame([(k, "A line.\n" + t) for k, t in probe], "want string, text string")
    bad = [(r["want"], r["text"], r["licences"]) for r in licences.scan(frame, fitted).collect()
           if {x["family"] for x in r["licences"]} - {licences.UNKNOWN} != ({r["want"]} if r["want"] != "none" else set())]
    assert not bad


def test_licences_wrapped_headers_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    probe = [(want, "\n".join(["Some title", mark.rstrip(), *[mark + x for x in header], mark.rstrip(), "The end of it."]))
             for want, header in (("gpl", gpl), ("bsd", bsd)) for mark in ("", " * ", "# ", "// ", "dnl ")]
    probe += [("mit", "First line here.\nReleased under the MIT License.\nLast line here."), (None, "one\n\ntwo"), (None, None), (None, "\n\n")]
    frame = spark.createDataFrame(probe, "want string, text string")
    bad = [(r["text"], r["licences"]) for r in licences.scan(frame, licences.model(docs)).collect()
           if [x["family"] for x in r["licences"] if x["family"] != licences.UNKNOWN] != ([r["want"]] if r["want"] else [])]
    assert not bad


def test_counts_after_edits_equal_a_full_count(spark, docs):
    count = edit_counts.counter(edit_counts.RANKS_FILE)
    for r in edit_counts.recount(docs).collect():
        c = r["counts"]
        assert c["n_tokens"] == count.whole(r["text"] or "") and c["n_tokens_after"] == count.whole(c["text"] or "") and (c["text"] is None) == (r["text"] is None)
    rnd = random.Random(2)
    for t in [x for x in TEXTS if x] + ["  \n " * 90, "don't " * 200]:
        tree = edit_counts.Tree.build(t, count)
        for _ in range(8):
            cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t) + 1, 6) // 2 * 2))
            edits = [(a, b, rnd.choice(["", " ", "new", " \n", "7"])) for a, b in zip(cuts[::2], cuts[1::2])]
            t, counted = tree.edit(t, edits, count)
            assert tree.tokens == count.whole(t)
    long = edit_counts.Tree.build(TEXTS[15], count)
    _, counted = long.edit(TEXTS[15], [(9000, 9003, "abc")], count)
    assert counted <= 4 * edit_counts.LEAF


def test_pipeline_against_its_operators_one_by_one(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.op1_quality_likelihood_ratio(spark, sf).collect()}
    kept = {i: d["text"] for i, d in docs.items() if judged[i]}
    ids = sorted(kept)
    parent = brute_similar([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if parent[k] == k}
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = contamination.item_words(r["text"])
        grams |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))}
    left = set()
    for i, t in kept.items():
        w = contamination.item_words(t)
        hit = {x for k in range(len(w) - 9) if tuple(w[k:k + 10]) in grams for x in range(k, k + 10)}
        if len(hit) <= 0.5 * len(w):
            left.add(i)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == left and len(got) == len(left) and all(r["round_trip"] for r in got)
