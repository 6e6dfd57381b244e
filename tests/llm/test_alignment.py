import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from tarnbeck.llm import alignment as al
from tarnbeck.llm.queries import op13_tokenizer_alignment

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def spans(texts):
    """(A tokens, B tokens) of each whole text as (id, start, end), or None; all by the libraries alone."""
    a = Tokenizer.from_file(al.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=al.PIECE_MODEL)
    e = al.Encoders(al.BYTE_VOCABULARY, al.PIECE_MODEL)
    out = []
    for t in texts:
        full = (" " + (t or "")).encode()
        if not t:
            out.append(None)
            continue
        sides = []
        for ids, sizes in ((a.encode(" " + t, add_special_tokens=False).ids, e.a_bytes), (b.encode(t), e.b_bytes)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(sizes[i])))
                at += len(sizes[i])
            sides.append(side)
        whole = [b"".join(table[i] for i, _, _ in s) for s, table in zip(sides, (e.a_bytes, e.b_bytes), strict=True)]
        out.append(sides if whole[0] == whole[1] == full else None)
    return out


def brute(rows):
    made = spans([t for _, t in rows])
    links = [[(x[0], y[0]) for x in s[0] for y in s[1] if x[1] < y[2] and y[1] < x[2]] if s else [] for s in made]
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), s, ls in zip(rows, made, links, strict=True):
        if s is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for *_, e in s[0]} & {e for *_, e in s[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for k, x, _ in side if low <= x < c) for side in s))
            low = c
        out.append((i, len(s[0]), len(s[1]), len(groups), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(n):
    r = random.Random(11)
    parts = ["Hello", "world,", "don't", "naïve", "日本語", "😀", "12", "3.5", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", "}\r", ");", "\x1f", "\x1c", "\xa0", "　", " ", "\x0b", "<|endoftext|>", "<s>", ".", "***", "=" * 33, "ß", "\x00", "\x85", "a.b", "we'll.", "I", "'s", "    return x"]
    return ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 25))) for _ in range(n)]


def run(spark, tmp_path, rows, files=5):
    path = f"{tmp_path}/docs-{len(rows)}"
    spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, n_a int, groups string").repartition(files).write.parquet(path)
    got = al.alignment_digests(spark.read.parquet(path)).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str)


def test_segments_encode_as_their_texts():
    e = al.Encoders(al.BYTE_VOCABULARY, al.PIECE_MODEL)
    assert e.cut_before() == " \n\t"
    import re

    rows = [t for t in texts(1500) if t]
    split = re.compile(al.split_pattern(e.cut_before())).split
    for t, s in zip(rows, spans(rows), strict=True):
        segs = [x for x in split(" " + t) if x]
        assert s is not None, repr(t)
        a = [i for x in e.a.encode_batch(segs, add_special_tokens=False) for i in x.ids]
        b = [i for x in e.pieces(segs) for i in x]
        assert (a, b) == ([i for i, *_ in s[0]], [i for i, *_ in s[1]]), repr(t)


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_DOCS", 7)
    rows = [(k // 2, t) for k, t in enumerate(texts(150))]
    rows += [(None, None), (None, "a b"), (7, ""), (8, " "), (9, "▁ low the line"), (9, "the low line"), (10, "x" * 5000), (11, "the " * 4000)] + [(12, "Copy of it.")] * 40
    assert run(spark, tmp_path, rows) == brute(rows)
    clean = [r for r in rows if "▁" not in (r[1] or "")]
    assert run(spark, tmp_path, clean) == brute(clean)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_query_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if t and len(t) < 3000]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op13_tokenizer_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    want = {r[0]: r for r in brute(short)}  # counts over the corpus need all texts; these do not
    assert all(got[i][:5] == want[i][:5] and got[i][7] == want[i][7] for i, _ in short)


def test_segments_are_those_of_the_pattern():
    import re

    import pyarrow as pa

    rows = [*texts(400), None, "", " ", "a　 b \tc\xa0\nd  e  f  g\x85 h​ i€ j"]
    segs, offs = al.segments_of(pa.array(rows, pa.string()), " \n\t")
    split, segs = re.compile(al.split_pattern(" \n\t")).split, segs.to_pylist()
    assert [segs[i:j] for i, j in zip(offs[:-1], offs[1:], strict=True)] == [split(" " + t) if t else [] for t in rows]


def test_blocks_are_bounded_by_bytes_and_no_join_is_held_whole(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 10)), pa.array(["x" * 100] * 9 + ["y" * 5000])], ["i", "t"]) for k in range(0, 50, 10)]
    made = [t.to_pydict() for t in al._blocks(iter(batches), 6, 1000)]
    assert [i for t in made for i in t["i"]] == list(range(50)) and max(len(t["i"]) for t in made) == 6
    monkeypatch.setattr(al, "BLOCK_BYTES", 500)
    rows = [(k, t) for k, t in enumerate(texts(60))]
    assert run(spark, tmp_path, rows) == brute(rows)
