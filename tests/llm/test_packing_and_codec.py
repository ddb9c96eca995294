import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patternloom.llm import packing, piece_codec

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n\n", None, "Don't they'll, it's… DONE!!", "x" * 3000, "naïve İstanbul é\u0301 日本語 🎉", "<|endoftext|> <|ENDOFTEXT|>,", "a'. b's, ''s", "3.14, 42; ok", "\u00a0\u2028z", "tail*** mid$$$dle %%%", "ab " * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(ODD)] + [(3, "again", "x", 2), (None, "no id", "x", 3)], "doc_id long, text string, piece string, length int")


def expected_pieces(rows):
    t, out = Tokenizer.from_file(BPE), []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            out.append((doc_id, n, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def test_pieces_are_the_tokenizers(docs):
    got = packing.pack_documents(docs, BPE).toPandas().astype(object).where(lambda x: x.notna(), None)
    assert sorted((tuple(r) for r in got.iloc[:, :5].itertuples(index=False)), key=str) == expected_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    check_places(got)


def test_recurring_words_are_encoded_once(monkeypatch):
    """However many other words a worker meets, those that each slice holds are never encoded again."""
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    learned, coder, library = [], packing.WordTokenizer(BPE), Tokenizer.from_file(BPE)
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda words: (learned.extend(words), learn(words)))
    letters = "abcdefghij"
    common = [f"{a}{b}retion" for a in letters[:4] for b in letters[:5]]
    for n in range(12):
        rare = [f"un{letters[n % 10]}{'x' * (n // 10)}{a}{b}th" for a in letters[:8] for b in letters[:5]]
        texts = [" ".join(common + rare[:20]), "Straße İ don't 3.14 " + " ".join(rare[20:])]
        ids, counts = coder.texts(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(learned.count(w) == 1 for w in common)
    assert len(coder.known) + len(coder.before) < 300


def check_places(got, capacity=4096):
    for _, g in got.astype({"offset": int, "length": int}).groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all() and g["length"].sum() <= capacity


def test_packing_reaches_the_bound(spark):
    lengths = np.random.default_rng(1).integers(1, 900, 3000)
    frame = pd.DataFrame({"doc_id": np.arange(3000), "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0})
    got = packing.pack(spark.createDataFrame(frame, packing.PIECES), part_items=300).toPandas()
    assert sorted(got["doc_id"]) == list(range(3000))
    check_places(got)
    assert got["sequence_id"].nunique() <= math.ceil(lengths.sum() / 4096) + 2
    assert (got["part_bins"] >= got["part_bound"]).all()


def test_equal_rows_spread(spark):
    row = (None, 0, 0, 900, 7)
    got = packing.pack(spark.createDataFrame([row] * 4000, packing.PIECES), part_items=500).toPandas()
    assert len(got) == 4000 and 1000 <= got["sequence_id"].nunique() <= 1008
    assert got.groupby("part").size().max() < 750
    check_places(got)


def test_empty_table(spark, docs):
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0
    assert piece_codec.encode(docs.limit(0), PIECES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_is_below_every_packing(lengths):
    capacity, best = 20, len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    array = np.array(lengths)
    bins, offsets, fills = packing.best_fit_decreasing(array, capacity)
    assert packing.bin_bound(array, capacity) <= best <= len(fills)
    assert all(fills[b] == array[bins == b].sum() <= capacity for b in range(len(fills)))


def test_codec_equals_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_codec.encode(docs, PIECES)
    got = sorted(((r["doc_id"], r["ids"]) for r in rows.collect()), key=str)
    assert got == sorted(((r["doc_id"], sp.encode(r["text"] or "")) for r in docs.collect()), key=str)
    assert rows.where("not round_trip").count() == 0
    back = piece_codec.decode(rows, PIECES)
    assert sorted(r["text"] for r in back.collect()) == sorted((r["text"] or "") for r in docs.collect())


def test_words_long_and_short_alike(spark):
    """Every word of the documents, by the batched recursion and alone, has the library's ids."""
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec._codec(PIECES)
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in (r["text"] or "").split(" ") if w and "▁" not in w})
    marked = ["▁" + w for w in words]
    flat, n = codec.words(marked)
    want = sp.encode(words)
    assert len(words) > 5000 and [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    assert [codec._long(w).tolist() for w in marked[::7]] == want[::7]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab cthe ioné.\n日🎉▁", max_size=60), max_size=6))
def test_codec_on_any_text(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec._codec(PIECES)
    ids, n = codec.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == sp.encode(texts)
    assert codec.decode(ids, n).to_pylist() == [sp.decode(sp.encode(t)) for t in texts]


def test_viterbi_over_merge_scores_differs():
    """Why the recursion asks which pairs stand: the best path by score isn't what the model's merges give."""
    codec, sp = piece_codec._codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def viterbi(word):
        best = [(0.0, [])] + [(-math.inf, [])] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 16), end):
                if (piece := codec.id_of.get(word[start:end])) and best[start][0] + sp.get_score(piece) > best[end][0]:
                    best[end] = (best[start][0] + sp.get_score(piece), [*best[start][1], piece])
        return best[-1][1]

    words = ["▁retitioning", "▁thononouinwh", "▁enneration", "▁understanding"]
    flat, n = codec.words(words)
    assert any(viterbi(w) != ids.tolist() for w, ids in zip(words, np.split(flat, np.cumsum(n)[:-1]), strict=True))
