"""Token alignment against whole texts encoded by both libraries, and plain counts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_operators import LONG, ODD, frame
from tessera.llm import registry, token_alignment
from tessera.llm.common import table


@pytest.fixture(scope="module")
def models():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(c): c for c in own} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in own)}
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if set(t) <= set(alphabet)}
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
    return a, b, a_bytes, b_bytes


def slow_groups(models, text):
    a, b, a_bytes, b_bytes = models
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
        return []
    ends = []
    for ids, names in ((x, a_bytes), (y, b_bytes)):
        at, own = 0, []
        for i in ids:
            at += len(names[i])
            own.append(at)
        ends.append(own)
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append((x[i:p], y[j:q]))
        i, j = p, q
    return out


def slow_sums(models, docs):
    found = [(i, slow_groups(models, t)) for i, t in docs]
    links = Counter((x[-1], y[-1]) for _, g in found for x, y in g)
    highest = {}
    for (_, y), n in links.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for i, g in found:
        own = [links[x[-1], y[-1]] for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(n == highest[y[-1]] for n, (_, y) in zip(own, g, strict=True)), sum(own), sha))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_alignment_query(spark, sf_dir, models):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = registry.QUERIES["op11_token_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert as_rows(got) == slow_sums(models, docs)


ODD_TEXTS = ["  two  spaces ", "tab\t then\n line \n\n  x", "\n ", " ", "a ▁ b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 のテキスト。", "é ​  x", "\x00 \x1c \x85 y", "🤷🏽‍♂️ok", "don't we'll   I'm", "x" * 3000, "1234567 89", "\r\n\r\n a　 b"]


def test_alignment_odd(spark, models):
    rows = [*ODD, *[(100 + k, t, "en") for k, t in enumerate(ODD_TEXTS)], (100, ODD_TEXTS[0], "en")]
    df = frame(spark, rows).withColumn("pair", F.lit(1)).withColumn("groups", F.lit("x")).withColumn("n_a", F.lit(2))
    want = slow_sums(models, [r[:2] for r in rows])
    assert as_rows(token_alignment.alignment_sums(df)) == want
    assert as_rows(token_alignment.alignment_sums(df, max_pairs=0)) == want, "the way beyond the broadcast"
    assert token_alignment.alignment_sums(df.limit(0)).count() == 0
    named = df.selectExpr("concat('d', doc_id) AS n", "text AS t")
    assert {r.n: r.groups_sha256 for r in token_alignment.alignment_sums(named, "n", "t").collect() if r.n} == {f"d{w[0]}": w[-1] for w in want if w[0] is not None}


def test_chunks_give_what_whole_texts_give(models):
    rng = random.Random(5)
    one = token_alignment.Aligner(*token_alignment.paths(), cache_words=50)
    signs = ["a", "The", "ß", "é", " ", " ", "  ", "\n", "\t", ".", ",", "7", "42", "'s", " ", " ", "日", "🙂", "\x1f", "▁"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(600)] + [LONG[:5000]]
    for k in range(0, len(texts), 40):
        for text, found in zip(texts[k : k + 40], one(texts[k : k + 40]), strict=True):
            want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in slow_groups(models, text))
            assert b";".join(e[0] for e in found or []).decode() == want, repr(text)


def test_links_join_tokens_that_end_each_other(spark, sf_dir, models):
    _, _, a_bytes, b_bytes = models
    counts = token_alignment.pair_counts(token_alignment.token_groups(table(spark, sf_dir, "documents"))).collect()
    for r in counts:
        x, y = a_bytes[r.pair >> 16], b_bytes[r.pair & 65535]
        assert x.endswith(y) or y.endswith(x)
    assert len(counts) <= token_alignment.most_pairs(*token_alignment.paths()) < token_alignment.MAX_PAIRS
