"""Alignment of tokens against a plain comparison of all byte ranges, with the public libraries as tokenizers."""

import collections
import hashlib
import random

import numpy as np
import pytest

from hearthpanel.llm import alignment

pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, row long, pairs string, n_a int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = [None, "", " ", "a", "\n\n  x", "a<|endoftext|>b </s><s>", "naïve ▁ mark", "日本語のテキスト 😀\u0001\u0000", "x" * 30_000,
           "don't stop 12345 — ok", "Größe\tund\r\nMaß", "the same", "the same"]
    words = "wind river tokenisation Straße antidisestablishment 1234567 don't -- 漢字 é".split()
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(25)] + [" ".join(rng.choice(words) for _ in range(6_000))]


def plain(texts):
    from tokenizers import Tokenizer
    a_codec = Tokenizer.from_file(FIRST)
    a_codec.encode_special_tokens = True
    b_codec = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters = alignment.byte_letters()

    def spans(pieces):
        out, at = [], 0
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs, counts = [], collections.Counter()
    for text in texts:
        a, b = (a_codec.encode(" " + text, add_special_tokens=False).ids, b_codec.encode(text)) if text else ([], [])
        pa = [bytes(letters[c] for c in a_codec.id_to_token(i)) for i in a]
        pb = [bytes([int(b_codec.id_to_piece(i)[3:-1], 16)]) if b_codec.is_byte(i) else b_codec.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and (b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode()):
            a, b, pa, pb = [], [], [], []
        sa, sb = spans(pa), spans(pb)
        links, low = [], 0
        for i, (s, e) in enumerate(sa):
            while low < len(sb) and sb[low][1] <= s:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([], []) for _ in cuts]
        for which, (ids, sp) in enumerate(((a, sa), (b, sb))):
            at = 0
            for i, (_, e) in zip(ids, sp):
                while e > cuts[at]:
                    at += 1
                groups[at][which].append(str(i))
        docs.append((len(a), len(b), len(cuts), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)))
        counts.update(links)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, g, len(links), sum(counts[l] == best[l[1]] for l in links), sum(counts[l] for l in links),
             hashlib.sha256(text.encode()).hexdigest() if text else "") for na, nb, g, links, text in docs]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_links_groups_and_counts(spark, texts, bound):
    docs = spark.createDataFrame([(i, t, 5, "clash", 1) for i, t in enumerate(texts)] + [(None, "the same", None, None, None)], SCHEMA).repartition(3)
    got = alignment.judge(docs, FIRST, SECOND, broadcast_pairs=bound)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["doc_id bigint", "n_a bigint", "n_b bigint", "n_groups bigint", "n_links bigint",
                                                  "n_best bigint", "count_sum bigint", "groups_sha256 string"]
    wanted = plain([*texts, "the same"])
    keys = [*range(len(texts)), None]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, *w) for k, w in zip(keys, wanted)), key=repr)
    assert wanted[6][0] == 0 and wanted[5][0] > 0


def test_groups_are_given_as_texts(spark):
    row = alignment.align(spark.createDataFrame([(1, "don't stop")], "doc_id long, text string"), FIRST, SECOND).first()
    assert row.n_groups == row.groups.count("|") and sum(row.times) == row.n_links
    assert alignment.judge(spark.createDataFrame([], "doc_id long, text string"), FIRST, SECOND).collect() == []


def test_pieces_of_any_size_merge_alike():
    rng = np.random.default_rng(4)
    for _ in range(60):
        size = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size + 1)), size)) for _ in range(2))
        whole = alignment.overlaps(a, b, 10_000)
        for work in (1, 2, 3, 7):
            i, j = alignment.cut_diagonals(a, b, work)
            assert set(np.diff(i + j)[:-1]) <= {work} and (i[-1], j[-1]) == (len(a), len(b))
            assert all((x == y).all() for x, y in zip(whole, alignment.overlaps(a, b, work)))
        assert whole[2].sum() == len(np.intersect1d(a, b)) and len(whole[0]) == len(np.union1d(a, b))
