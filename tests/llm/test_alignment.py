"""The cross-tokenizer alignment against its plain definition over whole texts."""

import bisect
import hashlib
from collections import Counter

import public_tokenizers
import pytest
from document_tables import table
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplewatch.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Text to ((id, first byte, end) of A, the same of B), or None where a side spells something else."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def spans(ids, spelled):
        out, at = [], 0
        for k, s in zip(ids, spelled, strict=True):
            out.append((k, at, at + len(s)))
            at += len(s)
        return out, b"".join(spelled)

    def encode(text):
        if not text:
            return None
        wanted = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids
        own, got = spans(ids, [bytes(alignment._byte_letters()[c] for c in a.id_to_token(k)) for k in ids])
        ids = b.encode(text)
        pieces = [b.id_to_piece(k) for k in ids]
        spelled = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, pieces)]
        other, also = spans(ids, spelled)
        return (own, other) if got == wanted == also else None

    return encode


def _pairs_by_byte(own, other):
    """Id pairs of tokens that share a byte: every byte names its two tokens."""
    owners = [[k for k, (_, low, high) in enumerate(side) for _ in range(low, high)] for side in (own, other)]
    return [(own[i][0], other[j][0]) for i, j in sorted(set(zip(*owners, strict=True)))]


def expected(texts, plain):
    coded = [plain(t) for t in texts]
    pairs = [_pairs_by_byte(*c) if c else [] for c in coded]
    count = Counter(p for own in pairs for p in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for c, own in zip(coded, pairs, strict=True):
        if not c:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        common = sorted({x[2] for x in c[0]} & {y[2] for y in c[1]})
        inside = [{high: [] for high in common} for _ in c]
        for held, side in zip(inside, c, strict=True):
            for k, _, end in side:
                held[common[bisect.bisect_left(common, end)]].append(str(k))
        groups = ["|".join(",".join(held[high]) for held in inside) for high in common]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        n_best = sum(count[p] == most[p[1]] for p in own)
        out.append((len(c[0]), len(c[1]), len(common), len(own), n_best, sum(count[p] for p in own), digest))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
EXTRA = [
    "a  b   c    d", " leading", "trailing ", "\n\nlines\n \n x", "tab\there", "a▁b", "▁", "<|endoftext|> and </s> <s>",
    "<0x41> \x00 nul", "日本語のテキスト 🙂🙂", "ﬁ ½ é ́ x", " hard space  ", " " * 50, "x" * 3000, "don't 12,345.67",
]


def test_report(spark, docs, rows, plain, no_docs):
    more = [(1000 + k, t) for k, t in enumerate(EXTRA)]
    both = docs.unionByName(table(spark, more)).repartition(3)
    every = rows + more
    want = [(k, *e) for (k, _), e in zip(every, expected([t for _, t in every], plain), strict=True)]
    for block in (500, 1 << 20):
        got = alignment.alignment_report(both, A, B, block_chars=block)
        assert got.columns == ["doc_id", *NAMES[:6], "groups_sha256"]
        got = sorted(map(repr, (tuple(r) for r in got.select("doc_id", *NAMES).collect())))
        assert got == sorted(map(repr, want))
    assert alignment.alignment_report(no_docs, A, B).collect() == []


def test_lists(docs, rows, plain, no_docs):
    got = alignment.align(docs, A, B).collect()
    by_ids = Counter((r.doc_id, tuple(r.a_ids), tuple(r.b_ids)) for r in got)
    want = Counter()
    for key, text in rows:
        c = plain(text) or ([], [])
        want[key, tuple(x[0] for x in c[0]), tuple(y[0] for y in c[1])] += 1
    assert by_ids == want
    for r in got:
        if r.groups:
            assert tuple(r.groups[-1]) == (len(r.a_ids), len(r.b_ids))
            assert len(r.links) == len(r.a_ids) + len(r.b_ids) - len(r.groups)
    assert alignment.align(no_docs, A, B).collect() == []


sizes = st.lists(st.integers(1, 6), min_size=1, max_size=30)


@settings(max_examples=300, deadline=None)
@given(sizes, sizes)
def test_cuts_and_links(a, b):
    short = sum(b) - sum(a)
    a, b = a + [short] * (short > 0), b + [-short] * (short < 0)
    ends = [[sum(x[: k + 1]) for k in range(len(x))] for x in (a, b)]
    found = alignment.cuts(a, b)
    assert [ends[0][i - 1] for i, _ in found] == sorted(set(ends[0]) & set(ends[1]))
    over = [
        (i, j)
        for i in range(len(a))
        for j in range(len(b))
        if max(ends[0][i] - a[i], ends[1][j] - b[j]) < min(ends[0][i], ends[1][j])
    ]
    assert alignment.links(a, b, found) == over
