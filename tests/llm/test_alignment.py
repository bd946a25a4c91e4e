"""Token alignment against the tokenizers' own libraries and plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from pathloom.llm.alignment import Segments, align_documents, op12_alignment, segments_of
from pathloom.llm.bpe import default_path

SF = "/root/testdata/sf0.001"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    from pathloom.llm.bpe import byte_chars

    a = Tokenizer.from_file(default_path(BYTES))
    a.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_chars())}
    b = sentencepiece.SentencePieceProcessor(model_file=default_path(PIECES))
    return a, byte, b


def tokens(libraries, text):
    """(ids and bytes of either side) as the libraries give them for the whole text."""
    a, byte, b = libraries
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return ids_a, bytes_a, ids_b, bytes_b


def plain(libraries, rows):
    """The contract for (doc_id, text): byte by byte."""
    out, counts, found = [], Counter(), []
    for doc_id, text in rows:
        links, groups = [], []
        if text:
            ids_a, bytes_a, ids_b, bytes_b = tokens(libraries, text)
            if b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                of = lambda parts: [i for i, x in enumerate(parts) for _ in x]  # noqa: E731  the token of each byte
                pairs = list(dict.fromkeys(zip(of(bytes_a), of(bytes_b), strict=True)))
                links = [(ids_a[i], ids_b[j]) for i, j in pairs]
                stops = [set(), set()]
                for stop, parts in zip(stops, (bytes_a, bytes_b), strict=True):
                    n = 0
                    for x in parts:
                        stop.add(n := n + len(x))
                for stop in sorted(stops[0] & stops[1]):
                    groups.append(([], []))
                both, group = sorted(stops[0] & stops[1]), groups
                for side, (ids, parts) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                    n = k = 0
                    for i, x in zip(ids, parts, strict=True):
                        n += len(x)
                        group[k][side].append(str(i))
                        k += n == both[k]
                counts.update(links)
                name = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
                found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(name.encode()).hexdigest(), name))
                continue
        found.append((doc_id, 0, 0, 0, links, "", None))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for doc_id, n_a, n_b, n_groups, links, sha, name in found:
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha, name))
    return sorted(out, key=repr), counts, best


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "▁", "a▁b c", "  two  spaces ", "\n", "\n\n x", "a\n b", "a\n  b", "tab\t x", "x 　 y", "\xa0 a", "a\xa0 b", "a\x1c b \x1c", "\x85 b", "<s> </s> <unk>", "<|endoftext|> x", "<0x0A> b",
    "日本 語 です", "🙂 🙂🙂", "é x", "\x00 a\x00", "don't I'll", "12345 678 9", "a" * 300, " " * 50 + "x", "x" + " " * 50, "​ a", "ﬁ ﬂ Å", "﻿ b", "مرحبا بالعالم", "  a  b",
]


def test_segments_are_encoded_as_the_whole(libraries):
    pick = random.Random(2)
    known = Segments(default_path(BYTES), default_path(PIECES), 128)
    texts = HARD + ["".join(pick.choice(["a", "b", " ", " ", "\n", "\t", "the", "é", "日", "\x1c", " ", "1", "!", "'s", "\xa0"]) for _ in range(pick.randint(1, 60))) for _ in range(1500)]
    known.add(list({s for text in texts for s in segments_of(text)}))
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = tokens(libraries, text)
        own = [known[s] for s in segments_of(text)]
        assert "".join(f" {s}" for s in segments_of(text)) == f" {text}"
        if b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            assert known.unlike.isdisjoint(own), repr(text)
            groups = [g.split("|") for i in own for g in known.strings[i].decode().split(";")]
            assert [int(x) for a, _ in groups for x in a.split(",")] == ids_a, text
            assert [int(x) for _, b in groups for x in b.split(",")] == ids_b, text
        else:
            assert not known.unlike.isdisjoint(own), repr(text)


def test_query_against_the_libraries(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op12_alignment(spark, SF).select(COLUMNS).collect()), key=repr)
    assert got == sorted((x[:-1] for x in plain(libraries, rows)[0]), key=repr)


def test_hard_rows(spark, libraries, corpus):
    """Null ids and texts, texts that one vocabulary can't give back, repeated rows, clashing names, few stripes and many salts."""
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(HARD)), (None, "one two"), (7, None), (10, "one"), (10, "one")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, stripe int, slice long, groups string").repartition(5)
    want, counts, best = plain(libraries, rows)
    for stripes, salt_bytes in ((128, 64 << 20), (3, 50)):
        found, pairs = align_documents(docs, default_path(BYTES), default_path(PIECES), stripes, with_groups=True, salt_bytes=salt_bytes)
        assert sorted((tuple(r) for r in found.select(*COLUMNS, "groups").collect()), key=repr) == want
        assert {(r.a_id, r.b_id): (r.n_links, r.best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    found, pairs = align_documents(docs.limit(0), default_path(BYTES), default_path(PIECES))
    assert found.collect() == [] and pairs.collect() == []


def test_one_very_long_text(spark, libraries):
    text = "tail word\n" * 150_000
    found, pairs = align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), default_path(BYTES), default_path(PIECES))
    assert [tuple(r) for r in found.select(COLUMNS).collect()] == [x[:-1] for x in plain(libraries, [(1, text)])[0]]
