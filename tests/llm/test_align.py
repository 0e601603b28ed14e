import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsloom.llm import align, queries
from tests.llm.conftest import DOCS, SF, edge_texts, rows

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


class Plain:
    """Whole-text encodings and all pairs of spans."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        self.of, n = {chr(b): b for b in keep}, 0
        for b in range(256):
            if b not in keep:
                self.of[chr(256 + n)] = b
                n += 1

    def spans(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], []
        out = []
        for toks in (a, b):
            at, spans = 0, []
            for i, x in toks:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def rows(self, docs):
        linked, counts = [], Counter()
        for _, t in docs:
            a, b = self.spans(t)
            links, lo = [], 0
            for i, s, e in a:
                while lo < len(b) and b[lo][2] <= s:
                    lo += 1
                links += [(i, j) for j, p, _ in b[lo:lo + e - s + 1] if p < e]
            counts.update(links)
            linked.append((a, b, links))
        top = {}
        for (_, j), n in counts.items():
            top[j] = max(top.get(j, 0), n)
        out = []
        for (d, _), (a, b, links) in zip(docs, linked):
            ends = sorted({e for *_, e in a} & {e for *_, e in b})
            lo, text = 0, []
            for e in ends:
                text.append("|".join(",".join(str(i) for i, s, f in x if lo <= s and f <= e) for x in (a, b)) if len(a) < 3000 else "")
                lo = e
            sha = hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""
            out.append((d, len(a), len(b), len(ends), len(links), sum(counts[x] == top[x[1]] for x in links),
                        sum(counts[x] for x in links), sha if len(a) < 3000 else None))
        return sorted(out, key=key)


def key(r):
    return tuple((x is None, x) for x in r)


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df, long_ones=()):
    out = [tuple(r[c] for c in [df.columns[0], *COLS]) for r in df.collect()]
    return sorted(((*r[:-1], None) if r[1] >= 3000 else r for r in out), key=key)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("hot", [1, 3000, 10**6])
def test_edge_documents(spark, edge_docs, plain, monkeypatch, hot):
    """hot: all, some or hardly any pairs through the shuffle join."""
    monkeypatch.setattr(align, "HOT_PAIRS", hot)
    assert got(align.align_documents(edge_docs, *PATHS)) == plain.rows(edge_texts())


def test_query_equals_plain_reading(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op11_token_alignment(spark, SF)
    assert got(out) == plain.rows(docs)


def test_empty_table(no_docs):
    assert align.align_documents(no_docs, *PATHS).count() == 0


def test_parts_change_nothing(plain):
    rnd = random.Random(8)
    signs = ["a", "Word", " ", "  ", "\n", "é", "中文", "'s", "<|endoftext|>", "<s>", "42", "😀", "\t", ".", "▁", "\x00", "don't"]
    aligner = align.Aligner(*PATHS)
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60)))
        a, b = plain.spans(text)
        split = align.parts(text, 5)
        assert "".join(split) == text
        whole = aligner([text])[0]
        assert (whole is None) == (not a)
        if whole:
            ids = [t for p in split for t in aligner.a.encode(p if p is not split[0] else " " + p, add_special_tokens=False).ids]
            assert ids == whole.a.tolist() == [i for i, *_ in a]
            assert [t for k, p in enumerate(split) for t in aligner.b.encode(p[1:] if k else p)] == whole.b.tolist() == [i for i, *_ in b]


def test_products_equal_dense_ones():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        x, y = rnd.integers(0, 3, (7, 9)) * (rnd.random((7, 9)) < 0.4), rnd.integers(0, 3, (9, 5)) * (rnd.random((9, 5)) < 0.4)

        def csr(m):
            return align.Csr(np.r_[0, np.cumsum((m != 0).sum(1))], np.nonzero(m)[1], m[m != 0], m.shape[1])

        for block in (1, 4, 1000):
            dense = np.zeros((7, 5), np.int64)
            for i, j, v in align.row_products(csr(x), csr(y), block):
                dense[i, j] = v
            assert (dense == x @ y).all()
        t = align.transpose(csr(x))
        assert t.width == 7 and (t.ptr == np.r_[0, np.cumsum((x != 0).sum(0))]).all()


def test_shared_group_links(plain):
    text = "Überstraße naïvely 中文 tokenisation, aujourd'hui"
    al = align.Aligner(*PATHS)([text])[0]
    pairs = {(int(i), int(j)) for x, y, _ in al.group_links() for i, j in zip(x, y)}
    assert pairs == {(i, j) for i, g in enumerate(al.a_groups) for j, h in enumerate(al.b_groups) if g == h}
    overlap = {(int(i), int(j)): int(v) for x, y, w in al.overlap_links() for i, j, v in zip(x, y, w)}
    assert set(overlap) <= pairs and sum(overlap.values()) == len(text.encode()) + 1


def test_long_texts_in_parts(spark, plain):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["der", "Straße", "über", "42", "naïve,"]) for _ in range(60_000))
    got_rows = got(align.align_documents(spark.createDataFrame(rows([(1, text), (2, "x" * 200_000)]), DOCS), *PATHS))
    want = plain.rows([(1, text), (2, "x" * 200_000)])
    assert [r[:5] for r in got_rows] == [r[:5] for r in want] and [r[5:7] for r in got_rows] == [r[5:7] for r in want]
