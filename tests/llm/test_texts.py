"""Decontamination, fingerprints, BPE and token shards against brute force."""

import random
import time
import uuid

import numpy as np
import pytest
import tiktoken

from lodestar.llm import _tokens, binary, bpe, decontaminate, fingerprints
from lodestar.llm import _text as X
from lodestar.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id long, score double, `Row Key` string"


def table(spark, texts):
    """Rows with extra columns of clashing names; ids from 0, a null id and repeated rows at the end."""
    rows = [(i, t, "en", "s", len(t or ""), 7, 0.5, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS)


def naive_leaks(text, items, n=8, least=5):
    words = [(m.group().lower(), m.start(), m.end()) for m in decontaminate.WORD.finditer(text)]
    found = {}
    for item, body in items:
        own = decontaminate.WORD.findall((body or "").lower())
        m = min(n, len(own))
        if item is None or not own:
            continue
        if m < least:
            if [w for w, _, _ in words] == own:
                found.setdefault((item, 0), set()).update(range(m))
            continue
        for k in range(len(own) - m + 1):
            for i in range(len(words) - m + 1):
                if [w for w, _, _ in words[i : i + m]] == own[k : k + m]:
                    found.setdefault((item, i - k), set()).update(range(i, i + m))
    out = set()
    for (item, _), places in found.items():
        run = sorted(places)
        cuts = [0, *[j for j in range(1, len(run)) if run[j] != run[j - 1] + 1], len(run)]
        out |= {(item, words[run[a]][1], words[run[b - 1]][2], b - a) for a, b in zip(cuts, cuts[1:], strict=False)}
    return out


def test_decontaminate(spark):
    rng = random.Random(2)
    vocabulary = ["Alpha", "béta", "gamma", "DELTA", "eps", "zeta", "eta9"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14)))) for k in range(12)] + [(90, None), (None, "a b c d e f"), (91, ""), (92, "Yes!"), (93, "béta GAMMA"), (3, "one two three four five six seven eight nine")]
    texts = ["", None, "no match at all", " ".join(vocabulary * 3), "yes", "(Béta, gamma)", "yes no", "béta"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = (items[rng.randrange(12)][1] or "").split()
            a = rng.randrange(len(own))
            parts += own[a:] if rng.random() < 0.5 else own
            parts += [rng.choice(vocabulary) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice(["  ", " -- ", ",\n", "_"]).join(parts).upper() if rng.random() < 0.5 else "… ".join(parts))
    texts.append("x " * 60_000 + "one, TWO three four five six seven eight nine" + " y" * 60_000)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    got = {}
    for r in decontaminate.find_leaks(docs, bench).collect():
        got.setdefault(r["doc_id"], []).append((r["item_id"], r["start_char"], r["end_char"], r["n_words"]))
    for i, t in enumerate(texts[1:-1], 1):
        assert sorted(got.get(i, [])) == sorted(naive_leaks(t or "", items)), t
    assert [x[3] for x in got[len(texts) - 1]] == [9]
    item, a, b, _ = got[len(texts) - 1][0]
    assert texts[-1][a:b] == "one, TWO three four five six seven eight nine"
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts)) if i not in got} | {None}
    # A small automaton takes several passes over the same texts.
    parts = decontaminate.find_leaks(docs, bench, decontaminate.LeakParams(automaton_chars=800))
    assert sorted(map(tuple, parts.filter("doc_id is not null").collect())) == sorted((d, *x) for d, own in got.items() if d is not None for x in own)
    empty = docs.filter("false")
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.filter("false")).count() == 0 and decontaminate.drop_leaks(empty, bench).count() == 0


def test_offsets_where_lower_case_is_longer():
    machine = decontaminate.build(list(decontaminate.windows([(1, "one two three four five")], decontaminate.LeakParams())))
    text = "İİ İ one two THREE four five İ"
    (_, a, b, n), = decontaminate.leaks(text, machine)
    assert text[a:b] == "one two THREE four five" and n == 5


def naive_fingerprint(text):
    h = []
    for base in fingerprints.BASES:
        x = 0
        for c in reversed(text):
            x = (x * base + ord(c)) % fingerprints.PRIME
        h.append(x)
    return h[0] << 31 | h[1]


def naive_block(text):
    lines, at, again, seen = [], 0, 0, set()
    for line in text.split("\n"):
        if line:
            lines.append((line, at))
            again += line in seen
            seen.add(line)
        at += len(line) + 1
    best = (0, 0, 0)
    for k, (line, b) in enumerate(lines):
        for other, a in lines[:k]:
            if other == line:
                n = 0
                while b + n < len(text) and text[a + n] == text[b + n]:
                    n += 1
                best = max(best, (n, -b, -a))
    n, b, a = best
    return len(lines), again, *((-a, -b, n) if n else (-1, -1, 0))


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "\n\n", "é\U0001f600x", "ab\nab", "ab\nab\nab\n", "x\ny\nx\ny\nz", "A\nX\nB\nY\nA\nB\nZ\nA\nB\nZ", "q\tz\nq\nq\tz\nq\nqq"] + ["\n".join(rng.choice(["aa", "b", "", "cc dd"]) for _ in range(rng.randint(1, 12))) for _ in range(50)] + ["long line\n" * 20_000]
    docs = table(spark, texts)
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        t = texts[0] if r["doc_id"] is None else texts[r["doc_id"]]
        if t is None:
            assert [r[c] for c in ("n_chars", "fingerprint", "n_lines", "copies", "first_doc")] == [None] * 5
            continue
        assert (r["n_chars"], r["fingerprint"]) == (len(t), naive_fingerprint(t) if len(t) < 1000 else r["fingerprint"])
        if len(t) < 1000:
            assert (r["n_lines"], r["n_repeated"], r["first_at"], r["again_at"], r["block_chars"]) == naive_block(t), t
        same = [i for i, x in enumerate(texts) if x == t]
        assert r["copies"] == len(same) + 3 * (t == texts[0]) and r["first_doc"] == same[0]
    h = fingerprints.prefix_arrays(np.array([ord(c) for c in "abcabcab"], np.uint32))
    assert fingerprints.extension(h, np.array([0, 0, 1]), np.array([3, 1, 4])).tolist() == [5, 0, 4]
    assert fingerprints.fingerprints(docs.filter("false")).count() == 0


TEXTS = ["", None, "Hello world", "  two  spaces\n\n\ttab ", "don't we'll I'm", "naïve café 東京 \U0001f600‍", "<|endoftext|> <|im_start|>", "a" * 3000, "x1y22 333 !!! ...", "\x00\x1c\x1d \x85  ", " ", "\n", "the " * 5000, "퟿�", "   x"]


def test_bpe_against_tiktoken(spark):
    rng = random.Random(8)
    alphabet = "abcdefgh  ÀéßЖ漢\n'0123.,-_\t\U0001f600"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=_tokens.load(), special_tokens={})
    docs = table(spark, texts)
    got = bpe.encode_documents(docs)
    rows = got.collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        t = texts[0] if r["doc_id"] is None else texts[r["doc_id"]]
        if t is None:
            assert r["ids"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["ids"] == reference.encode_ordinary(t), t
            assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    again = {r["doc_id"]: r["text"] for r in bpe.decode_documents(got).collect()}
    assert all(again[i] == t for i, t in enumerate(texts))
    assert bpe.encode_documents(docs.filter("false")).count() == 0


def test_bpe_leftmost_pair_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258, b"aab": 259}
    own = bpe.Coder(ranks, bpe.merges_of(ranks))
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["aaaa", "aab", "aaab", "baaaaab", "a", "aaaaaaa"]
    flat, firsts = own.contract_all(words)
    assert [flat[a:b].tolist() for a, b in zip(firsts, firsts[1:], strict=False)] == [reference.encode_ordinary(w) for w in words]
    with pytest.raises(KeyError):
        own.decode(np.array([9999]), np.array([0, 1]))


def test_bpe_step_sorts_nothing():
    """The step that is run again and again has no window, whose sort took about a third of a contraction, and gives the tokens of the reference."""
    ranks = _tokens.load()
    own = bpe.Coder(ranks, bpe.merges_of(ranks))
    words = [" unbelievable", "aaaaaaa", "x", " strengthened", "\u4e2d\u6587\u5b57", "0123456789"]
    tokens, firsts = own.contract([w.encode() for w in words])
    assert [tokens[a:b].tolist() for a, b in zip(firsts, firsts[1:], strict=False)] == [_tokens.encoding(ranks).encode_ordinary(w) for w in words]
    own.con.execute("CREATE TABLE start_rows(word INTEGER, pos INTEGER, id INTEGER)")
    plan = "".join(r[1] for r in own.con.execute("EXPLAIN " + bpe.CONTRACT).fetchall()).lower()
    # Those of the first rows only: their successors and their words' least codes.
    assert plan.count("─ window") == 2, plan


def test_bpe_long_words():
    """Words without a space: cut into pieces, mended at the seams, equal to the whole; a repeated unit shifts every seam."""
    own = bpe.Coder(_tokens.load(), bpe.merges_of(_tokens.load()))
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=_tokens.load(), special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)), "aab" * 3001, "z" * 5001, "=-" * 2500]
    for _ in range(30):
        word = "".join(rng.choice(rng.choice(["ab", "aAbB", "的一是", "0-=_"])) for _ in range(rng.randint(100, 700)))
        words.append(word[: rng.randint(1, 7)] * rng.randint(50, 200) if rng.random() < 0.3 else word)
    began = time.time()
    tokens, firsts = own.encode(words)
    assert time.time() - began < 60
    assert [tokens[a:b].tolist() for a, b in zip(firsts, firsts[1:], strict=False)] == [reference.encode_ordinary(w) for w in words]
    assert own.decode(tokens, firsts) == words


def test_token_shards(spark):
    texts = TEXTS + [f"document {i} words" for i in range(300)]
    docs = table(spark, texts)
    place = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = binary.write_ids(docs.repartition(3), place, binary.BinaryParams(keys=100)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        by.setdefault(r["bucket"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) > 1
    reference = tiktoken.Encoding("t", pat_str=_tokens.PATTERN, mergeable_ranks=_tokens.load(), special_tokens={})
    reader = binary.Reader(place)
    for i, t in enumerate(texts):
        assert reader.get(i).tolist() == reference.encode_ordinary(t or "")
    assert [reader.get(k) for k in (10**9, -1, len(texts))] == [None] * 3
    empty = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    assert binary.write_ids(docs.filter("false"), empty).count() == 0 and binary.Reader(empty).get(1) is None


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        _, slots = binary.build_hash(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_words_and_blocks():
    data, offsets, valid = X.strings(__import__("pyarrow").array(["a bc", None, "", " d e "]))
    starts, ends, firsts = X.spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bc", "d e"] and firsts.tolist() == [0, 2, 2, 2, 3] and valid.tolist() == [True, False, True, True]
    h = X.prefix(np.frombuffer(b"abcabc", np.uint8))
    assert X.span_hash(h, np.array([0]), np.array([3])) == X.span_hash(h, np.array([3]), np.array([6]))
    assert list(X.blocks(np.array([0, 5, 5, 20, 22]), 6)) == [(0, 2), (2, 3), (3, 4)]


