import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.common import no_docs, odd_docs, rows
from weftline.llm import packing, token_counts
from weftline.llm.word_bpe import word_bpe
from weftline.scratch import new_path

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "it's O'Neil 3,5 don't", "<|endoftext|> a<|startoftext|>b", "éÉ×÷ß ǅ İstanbul", "!!!??? a.b c-d", "x" * 200, "日本語 テスト", "á é", "\x00 \x1c a\x85b c", "ÀÈÌ.,;", "'s 't 'S", "*** $$$", "a  b", " a", "▁b c"]


def test_word_bpe_equals_the_library():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdefghijklmnop éèßÀ.,'!?*&3\n") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    ids, cuts = word_bpe(WORD).encode(pa.array(texts))
    library = Tokenizer.from_file(WORD)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids, texts[i]


def test_best_fit_is_that_of_a_plain_search():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 700)
    place, offset = packing.best_fit_decreasing(lengths, 128)
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in free if c >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(128 - lengths[i])
    assert place.max() + 1 == len(free)
    ends = defaultdict(list)
    for p, o, n in zip(place, offset, lengths, strict=True):
        ends[p].append((o, o + n))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 128
        assert all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


@pytest.mark.parametrize("window", [64, 4096])
def test_pack_keeps_every_id_once(spark, window):
    library = Tokenizer.from_file(WORD)
    want = sorted(tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (2,) for r in rows())
    packed = packing.pack(odd_docs(spark), WORD, window).collect()
    docs, windows = defaultdict(dict), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) >= 0
        docs[r["doc_id"], r["doc_tokens"]].setdefault(r["start"], []).append(tuple(ids.tolist()))
        windows[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    got = []
    for pieces in docs.values():
        copies = len(pieces[0])
        got += [tuple(i for s in sorted(pieces) for i in pieces[s][0])] * copies
    assert sorted(got) == want
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= window
        assert all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert len(windows) <= sum(map(len, want)) / window * 1.1 + 2
    assert packing.sequences(packing.pack(odd_docs(spark), WORD, window)).count() == len(windows)
    assert packing.pack(no_docs(spark), WORD, window).count() == 0


def test_counts_through_a_warm_cache(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counter = token_counts.piece_counter(PIECE)
    assert counter.counts(pa.array(ODD)).tolist() == [len(library.encode(x)) for x in ODD]
    cache = new_path(spark, "cache")
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows())
    for _ in range(2):
        got = token_counts.token_counts(odd_docs(spark), PIECE, cache)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    # The second run appended nothing, and each text is stored once.
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows()})
    assert token_counts.token_counts(no_docs(spark), PIECE, cache).count() == 0
