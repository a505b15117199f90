"""Line dedup, cross-tokenizer alignment and the Merkle manifest against brute force, on small rows with nulls,
empty and long texts, ties, repeated rows, and extra columns with clashing names."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skuforge.llm import alignment, manifest, shared_lines

RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randrange(2, 8))) for _ in range(200)]


def line(seed, n=6):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SHARED = ["A shared line of many words", "  a SHARED line of many words\t", "ünïcödé line of twenty or more", "x" * 20, "y" * 19, "é" * 10, "é" * 20]


def texts():
    out = [None, "", "\n\n", SHARED[0], SHARED[1] + "\n" + SHARED[1], "\n".join(SHARED), "\n".join(SHARED[2:]) + "\n", "x" * 20 + "\r\n" + "y" * 19]
    for i in range(60):
        r = random.Random(i)
        out.append("\n".join(r.choice(SHARED) if r.random() < 0.3 else line(r.randrange(400)) for _ in range(r.randrange(1, 12))))
    return [*out, "\n".join(line(i) for i in range(3000)), "z" * 100_000]


ROWS = [(i, t) for i, t in enumerate(texts())] + [(9, SHARED[0]), (9, SHARED[0]), (None, SHARED[0]), (None, None), (700, "\n".join(SHARED)), (701, SHARED[6])]
SCHEMA = "doc_id long, text string, key string, block string, row double"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "k", "b", 0.5) for i, t in rows], SCHEMA).repartition(5)


def strip_key(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows):
    holders = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            for x in t.split("\n"):
                if len(strip_key(x)) >= 20:
                    holders[strip_key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[strip_key(x)]) < 3 or i == max(holders[strip_key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_shared_lines_match_brute_force(spark):
    want = brute_lines(ROWS)
    assert sum(r[2] for r in want) > 100
    got = shared_lines.drop_shared_lines(frame(spark), keep_text=False)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    # many segments and small blocks
    size, shared_lines.BLOCK_KEYS = shared_lines.BLOCK_KEYS, 7
    try:
        got = shared_lines.drop_shared_lines(frame(spark), segment_keys=2)
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=repr) == want
    finally:
        shared_lines.BLOCK_KEYS = size


def test_no_rows_of_new_operators(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    assert shared_lines.drop_shared_lines(nothing).count() == 0
    assert alignment.alignment_counts(nothing).count() == 0
    assert alignment.groups(nothing).count() == 0
    assert manifest.verify(nothing, manifest.with_claim(nothing, {})).count() == 0


def test_filters_keep_every_value_seen_twice():
    import numpy as np

    r = np.random.default_rng(3)
    blocks = [(np.unique(r.integers(0, 1 << 32, 4000, np.uint32)), None) for _ in range(6)]
    blocks = [(v, r.random(len(v)) < 0.01) for v, _ in blocks]
    blocks[3] = (np.union1d(blocks[3][0], blocks[0][0][:500]), np.zeros(len(np.union1d(blocks[3][0], blocks[0][0][:500])), bool))
    count = collections.Counter(x for v, _ in blocks for x in v.tolist())
    wrong = once = 0
    for (values, repeated), hit in zip(blocks, shared_lines.seen_twice(blocks)):
        for v, d, h in zip(values.tolist(), repeated.tolist(), hit.tolist()):
            assert h or not d and count[v] == 1
            once += count[v] == 1
            wrong += h and count[v] == 1 and not d
    assert wrong < 0.1 * once


ALIGN_TEXTS = [
    None, "", " ", "  ", "a", " lead", "tail ", "tail  ", "two  spaces and   three", "line one\nline two\n\n\tx \n y", "don't <|endoftext|> <s> </s> <unk> <0x41>",
    "naïve café ΑΒΓ кириллица 漢字かな 한글", "😀 mixed 👩‍👩‍👧 text🎉end", "▁under ▁", "tabs\tand nbsp 　wide \x1cfs \x85nel",
    "x" * 3000, "qz" * 700 + " é" * 50, "é combining ﬁ ligature ① Å", "\x00nul \x7f �", "repeat repeat repeat  repeat", "12345 67,890.12 $#@! ...", "a \n b", "𝔘𝔫𝔦 ✓✗ ☃",
    "hello world " * 200, "der Straße größer Übermut " * 20,
]


def brute_alignment(texts):
    """Whole texts through both tokenizers, groups from cumulated decoded bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(alignment.BPE_FILE)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_FILE)
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    char = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            char[chr(256 + len(char) - len(plain))] = b
    docs = []
    for t in texts:
        groups = []
        if t:
            raw = (" " + t).encode()
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            xs = [bytes(char[c] for c in a_tok.id_to_token(i)) for i in a]
            ys = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(xs) == raw == b"".join(ys):
                i = j = x = y = 0
                one, two = [], []
                while i < len(a) or j < len(b):
                    if x <= y:
                        one.append(a[i])
                        x += len(xs[i])
                        i += 1
                    else:
                        two.append(b[j])
                        y += len(ys[j])
                        j += 1
                    if x == y:
                        if not two or len(one) == 0:
                            continue
                        groups.append((x, one, two))
                        one, two = [], []
        docs.append(groups)
    held = collections.Counter(p for g in docs for p in {(a, b) for _, one, two in g for a in one for b in two})
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g in docs:
        ties = [(a, b) for _, one, two in g for a in one for b in two]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for _, one, two in g)
        out.append((sum(len(x[1]) for x in g), sum(len(x[2]) for x in g), len(g), len(ties), sum(held[p] == best[p[0]] for p in ties), sum(held[p] for p in ties),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return docs, out


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_matches_whole_texts(spark, hot_pairs):
    rows = list(enumerate(ALIGN_TEXTS)) + [(3, "a"), (None, "a")]
    docs, want = brute_alignment([t for _, t in rows])
    got = alignment.alignment_counts(frame(spark, rows), hot_pairs=hot_pairs).collect()
    assert sorted(((r["doc_id"], *[r[c] for c in FIGURES]) for r in got), key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)
    assert want[13][0] == 0 and want[12][0] > 0
    if hot_pairs == 40:
        spans = {r["doc_id"]: r["groups"] for r in alignment.groups(frame(spark, rows[:25])).collect()}
        for i in range(25):
            assert [(g["end"], list(g["a"]), list(g["b"])) for g in spans[i]] == docs[i]
            assert all(x["end"] == y["begin"] for x, y in zip(spans[i], spans[i][1:]))


def test_alignment_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    _, want = brute_alignment([t for _, t in rows])
    got = alignment.op12_span_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], *[r[c] for c in FIGURES]) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(leaves):
    """(root, proof as one list of (siblings left, siblings right) for each leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k in range(len(leaves)):
            run, slot = at[k] // 3 * 3, at[k] % 3
            kids = level[run:run + 3]
            paths[k].append(("".join(kids[:slot]), "".join(kids[slot + 1:])))
            at[k] //= 3
        level = [sha(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        leaf = brute_leaf((r[0], r[1], r[2], r[3], r[4]))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        text = r[4].replace("\n", "") if hit and r[4] is not None else r[4]
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, brute_leaf((r[0], r[1], r[2], r[3], text))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(groups[s]), *brute_tree([x[2] for x in sorted(groups[s])])) for s in names]
    root, above = brute_tree([t[1] for t in trees])
    out = []
    for (own, sub, paths), up in zip(trees, above):
        for (there, i, leaf, acc), path in zip(own, paths):
            proof = path + up
            for a, b in proof:
                acc = sha(a, acc, b)
            out.append((i if there else None, leaf, sub, root, sha(*[a + b for a, b in proof]), acc, acc == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes,levels", [({"a": 1}, 6), ({"a": 3, None: 4, "": 1, "é": 28, "b": 10}, 2), ({f"s{i}": 1 + i % 5 for i in range(40)} | {"hot": 200}, 1), ({"w": 800, "v": 730}, 6)])
def test_manifest_matches_brute_force(spark, sizes, levels):
    rows, k = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((k, name, None if k % 7 == 0 else "en", None if k % 5 == 0 else k, None if k % 11 == 0 else ["", "one\ntwo é", "plain", "z" * 3000 + "\n"][k % 4]))
            k += 1
    if len(rows) > 20:
        rows += [(3, rows[3][1], "en", 1, "twice"), rows[5], (None, rows[7][1], None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, claim int").repartition(4)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    forged = manifest.with_claim(docs, {"text": F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    got = manifest.verify(docs, forged, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)
