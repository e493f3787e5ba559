"""Operators on single texts against plain definitions: BPE, token files, fingerprints, chat, toxicity."""

import base64
import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplewatch.llm import bpe, chat, lzprint, tokenfiles, toxicity
from ripplewatch.llm.common import shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library_and_round_trips(docs, rows, tiktoken_encoding):
    want = []
    for key, text in rows:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((key, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, block_chars=2000).collect()
    assert by_repr(got) == by_repr(want)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS).collect()
    assert by_repr((r[0], bytes(r[1]).decode()) for r in back) == by_repr((k, t or "") for k, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=24), max_size=20))
def test_replay_is_word_by_word_merging(words):
    vocabulary = bpe.load_ranks(RANKS)
    ids, offsets = bpe.replay(words, vocabulary)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == [vocabulary.one_by_one(w) for w in words]


def test_replay_of_an_odd_vocabulary():
    """A merge that makes a lower-ranking pair possible is noticed."""
    pieces = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"abab"]
    vocabulary = bpe.Vocabulary({p: k for k, p in enumerate(pieces)})
    words = [b"abcabc", b"ababab", b"bcab", b"aabbcc", b"abcbcbabc"]
    ids, offsets = bpe.replay(words, vocabulary)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == [vocabulary.one_by_one(w) for w in words]


def test_token_files_hold_the_library_ids_in_order(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for key, text in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = shared_folder(spark, "tokens")
    manifest = tokenfiles.write_tokens(docs, folder, TOKENIZER, 2, rows_per_file=9)
    assert manifest.count() > 3
    assert by_repr(tokenfiles.read_tokens(manifest, digests=True).collect()) == by_repr(want)
    whole = {r["start"]: r["ids"] for r in tokenfiles.read_tokens(manifest).collect()}
    assert [zlib.crc32(np.array(whole[w[1]], "<u4").tobytes()) for w in want] == [w[3] for w in want]


def test_token_encoder_on_white_space_and_control_strings():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    texts = ["", " ", "a  b", "a \n b", " a", "a ", "a\nb c", "<|endoftext|> x", "don't  's", "\u00a0 x\u2003y", "a\tb \x1cc"]
    texts += [" ".join(p) for p in itertools.product(["a", "", "\n", "b."], repeat=3)]
    got = tokenfiles.WordEncoder(TOKENIZER).encode(texts)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_agree_with_the_plain_library_call_on_added_tokens(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    mark = "<|endoftext|>"
    texts = [f"a{mark}b", mark, f"a {mark} b", f"{mark}{mark}", f"a\n{mark}\n b", f" {mark}", f"{mark} ", f"a  {mark}  b", "<|endoftext", "after"]
    want, start = [], 0
    for key, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = tokenfiles.write_tokens(frame, shared_folder(spark, "tokens"), TOKENIZER, 2, rows_per_file=4)
    assert by_repr(tokenfiles.read_tokens(manifest, digests=True).collect()) == by_repr(want)


def _phrases(text):
    seen, now = set(), ""
    for ch in text:
        now += ch
        if now not in seen:
            seen.add(now)
            now = ""
    return seen


def test_fingerprints_of_neighbours(docs, rows):
    got = lzprint.compare_neighbours(docs, rows_per_bucket=7).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    texts = [t or "" for _, t in order]
    prints = [lzprint.fingerprint(t) for t in texts]
    want = []
    for k, (key, _) in enumerate(order):
        text, after = texts[k], (k + 1) % len(texts)
        copy = lzprint.edited(text, texts[after])
        mark = lzprint.fingerprint(copy)
        digest = hashlib.sha256(copy.encode()).hexdigest()
        near = lzprint.likeness(prints[k], mark), lzprint.likeness(prints[k], prints[after])
        want.append((key, len(text), digest, prints[k], mark, *near))
    assert by_repr(got) == by_repr(want)


def test_likeness_follows_the_phrase_sets(rows):
    texts = [t for _, t in rows if t and len(t) > 200]
    errors = []
    for a, b in itertools.pairwise(texts):
        x, y = _phrases(a), _phrases(lzprint.edited(a, b))
        got = lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(lzprint.edited(a, b)))
        errors.append(abs(got - len(x & y) / len(x | y)))
    assert sum(errors) / len(errors) < 0.08
    assert lzprint.likeness(lzprint.fingerprint(""), lzprint.fingerprint("")) == 1.0


@given(st.text(alphabet="\\<|/s>[INST]Y a\n", max_size=40), st.text(alphabet="<|end|>\\", max_size=12))
def test_rendering_is_reversible(text, role):
    piece, _, _ = chat.render(role, text)
    assert chat.read_back(piece) == [(role, text)]
    piece, low, high = chat.render("assistant", text)
    assert chat.unescape(piece[low:high]) == text


def test_layouts_become_the_same_turns():
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a"},
    ]
    assert all(chat.turns_of(json.dumps(r)) == turns for r in records)
    assert chat.turns_of(json.dumps({"instruction": "q", "input": "x", "output": None})) == [("user", "q\n\nx"), ("assistant", "")]
    assert chat.turns_of('{"unknown": 1}') is None and chat.turns_of("no json") is None and chat.turns_of(None) is None
    assert chat.turns_of('{"messages": []}') == []


def test_chat_digests(spark):
    said = [(7, 1, "assistant", "b"), (7, 0, "user", "a</s>"), (8, 0, "user", None), (8, None, None, "x"), (None, 0, "user", "z")]
    said += [(9, 0, "assistant", "[INST]"), (9, 0, "assistant", "[INST]")]
    frame = spark.createDataFrame([(*s, "extra") for s in said], "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(chat.records_of_turns(frame))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[7]["turns_sha256"] == sha("user\na</s>\nassistant\nb\n") and got[7]["loss_sha256"] == sha("b")
    assert got[8]["turns_sha256"] == sha("\nx\nuser\n\n") and got[8]["loss_chars"] == 0
    assert got[9]["n_turns"] == 2 and got[9]["loss_sha256"] == sha("[INST][INST]") and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_chat(chat.records_of_turns(frame.limit(0)))).count() == 0


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else _next_row(row, i, x, b)
        return row[-1]

    def _next_row(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    terms = ["abcab", "bacca", "cc"]
    automaton = toxicity.Automaton(terms, ["acb"])
    for n in range(7):
        for letters in itertools.product("abc", repeat=n):
            word = "".join(letters)
            if word in terms:
                want = 1
            elif word.startswith("acb") and len(word) > 3:
                want = 3
            else:
                want = 2 if any(len(t) >= 5 and distance(word, t) <= 1 for t in terms) else 0
            assert automaton.match(word) == want, word


def test_quoted_ranges():
    text = 'he said "you idiot" and «fool» but "open\nline" idiot'
    assert [text[a + 1 : b] for a, b in toxicity.quoted_ranges(text)] == ["you idiot", "fool"]


def test_toxicity_learns_from_training_rows_only(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs, labels = [], []
    for k in range(600):
        words, toxic = [word() for _ in range(30)], int(k % 6 == 0)
        if toxic:
            words[r.randrange(30)] = r.choice(["blarghy", "zzorp"])
            words[r.randrange(30)] = "vilex" + word()[:3]
        docs.append((k, " ".join(words), "x"))
        held = zlib.crc32(str(k).encode()) % 3 == 1
        labels.append((k, 1 - toxic if held else toxic))  # labels of held-out rows are wrong on purpose
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "blarhgy zzorp blarghyy", "x"), (None, "zzorp blarghy", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    scorer = toxicity.learn(frame, marks)
    assert {"blarghy", "zzorp"} <= set(scorer.words) and any(s.startswith("vilex") for s in scorer.stems)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, scorer).collect()}
    assert len(got) == len(docs)
    wrong = [k for k in range(600) if (got[k] >= 0.7) != (k % 6 == 0)]
    assert len(wrong) < 12
    assert got[1000] == got[1001] < 0.3
    kept = toxicity.accepted(frame, scorer)
    assert kept.columns == frame.columns and kept.count() == sum(s < 0.7 for s in got.values())
    assert toxicity.learn(frame, marks.limit(0)).score("zzorp") < 0.01
    assert toxicity.score(frame.limit(0), scorer).count() == 0


def test_empty_tables(spark, no_docs):
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert lzprint.compare_neighbours(no_docs).count() == 0
    manifest = tokenfiles.write_tokens(no_docs, shared_folder(spark, "tokens"), TOKENIZER, 2)
    assert tokenfiles.read_tokens(manifest, digests=True).count() == 0


def test_toxicity_keeps_every_term_that_passes(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    bad, plain = [word() for _ in range(6500)], [word() for _ in range(50)]
    said = [[] for _ in range(90)]
    for w in bad:
        for k in r.sample(range(90), 16):
            said[k].append(w)
    for words in said:
        r.shuffle(words)
    texts = [" ".join(words) for words in said] + [" ".join(r.choices(plain, k=12)) for _ in range(900)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 90)) for k in range(len(texts))], "doc_id long, toxic int")
    scorer = toxicity.learn(frame, marks)
    assert len(set(bad) & set(scorer.words)) > 6000


def test_records_that_fit_no_layout_or_no_text():
    assert chat.turns_of('{"messages":[{"role":"user","content":"x"},[]]}') is None
    assert chat.turns_of('{"messages":[{"role":"user","content":"x"},{"role":[],"content":"y"}]}') is None
    assert chat.turns_of('{"messages":[{"role":"user","content":"x"},{"role":"user","content":{}}]}') is None
    assert chat.turns_of("[" * 100_000) is None and chat.turns_of('{"a":' * 100_000 + "1" + "}" * 100_000) is None
    assert chat.turns_of('{"role":"user","text":"a\\ud800b\\ud83d\\ude42"}') == [("user", "a\ufffdb\U0001f642")]
    assert chat.turns_of('{"\\ud800":1}') is None
    for value, shown in (("0", "0"), ("false", "false"), ("null", ""), ("1.5", "1.5"), ('""', "")):
        assert chat.turns_of(f'{{"role":"bot","text":{value}}}') == [("assistant", shown)]
        want = [("user", shown), ("assistant", "y")]
        assert chat.turns_of(f'{{"prompt":{value},"response":"y"}}') == want
    assert chat.turns_of('{"role":1,"content":"x"}') == [("1", "x")]
