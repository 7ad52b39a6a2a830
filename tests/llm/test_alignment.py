import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from quarryline.llm import alignment, queries

SF, FILES = "/root/testdata/sf0.001", ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """(ids, bytes) of a text's tokens by each side, from the libraries themselves."""
    a, b = tokenizers.Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    visible = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def sides(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        return one, two

    return sides


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(plain, rows):
    made = []
    for key, text in rows:
        sides = plain(text) if text else ([], [])
        if text and any(b"".join(d for _, d in s) != b" " + text.encode() for s in sides):
            sides = ([], [])
        one, two = map(spans, sides)
        links, lo = [], 0
        for i, s, e in one:
            while lo < len(two) and two[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(two) and two[k][1] < e:
                links.append((i, two[k][0]))
                k += 1
        ends = sorted({e for *_, e in one} & {e for *_, e in two})
        groups = [(s, e) for s, e in zip([0, *ends], ends)]
        text_of = lambda side, s, e: ",".join(str(i) for i, _, x in side if s < x <= e)
        joined = ";".join(f"{text_of(one, s, e)}|{text_of(two, s, e)}" for s, e in groups) if len(text or "") < 5000 else None
        made.append((key, one, two, groups, links, joined))
    counts = Counter(link for *_, links, _ in made for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else x
    return sorted(
        ((k, len(a), len(b), len(g), len(x), sum(counts[y] == most[y[1]] for y in x), sum(counts[y] for y in x), digest(j)) for k, a, b, g, x, j in made),
        key=repr,
    )


def agree(got, want):
    got, long = sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr), {w[:7] for w in want if w[7] is None}
    assert len(got) == len(want)
    assert sorted(((*g[:7], None) if g[:7] in long else g for g in got), key=repr) == want


def test_query_equals_brute_force(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    agree(queries.QUERIES["op13_token_alignment"](spark, SF).collect(), brute(plain, docs))


def test_odd_rows_in_small_chunks(spark, plain, monkeypatch):
    rng = random.Random(13)
    texts = [None, "", " ", "  ", "a", "<|endoftext|> <s>x</s> <unk> <0x41>", "▁▁ a▁b", "\n\r\t \x00\x7f", "héllo 😀👩‍👩‍👧 漢字かな", "ﬁ é é", "a" * 3000, " \n" * 900]
    texts += ["".join(rng.choice("ab cdé😀\n▁1,'") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[8]), (3, texts[8]), (None, texts[8]), (None, None), (99, "the same words again " * 3000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n long, chunk string").repartition(2)
    held, want = alignment.Tokenizers.read(*FILES), brute(plain, rows)
    agree(alignment.align(df, held).collect(), want)
    agree(alignment.align(df, held, chunk_bytes=300).collect(), want)
    agree(alignment.align(df.limit(0), held).collect(), [])
    monkeypatch.setattr(alignment, "SLICE_TOKENS", 50)
    same = [t for t in texts if t and "▁" not in t]
    ids = alignment.pa.list_(alignment.pa.int32())
    a = alignment.pa.array([held.encode_a(" " + t) for t in same], ids)
    b = alignment.pa.array([held.encode_b(t) for t in same], ids)
    parts = [x.digests() for _, _, x in alignment._slices(held, a, b)]
    whole = alignment.Layout(held, a, b).digests()
    assert len(parts) > 3 and sum(parts, []) == whole


def test_bytes_that_are_no_text_have_no_tokens(spark):
    df = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text union all select 2L, 'ab'")
    got = {r["doc_id"]: r for r in alignment.align(df, alignment.Tokenizers.read(*FILES)).collect()}
    assert got[1]["n_a"] == 0 and got[1]["groups_sha256"] == "" and got[2]["n_links"] > 0


def test_fast_encoder_equals_the_plain_one(plain):
    held, rng = alignment.Tokenizers.read(*FILES), random.Random(4)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x4E00, 0x9FFF), 0x1F600, 10, 32])) for _ in range(60))
        assert list(held.encode_a(" " + text)) == [i for i, _ in plain(text)[0]]
    blanks = "x" + " " * 120_000 + "y"
    assert sum(len(held.a_bytes[int(i)].as_py()) for i in held.encode_a(blanks)) == len(blanks)
