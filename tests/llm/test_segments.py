"""Texts cut into segments that are encoded once each, against encoding whole texts."""

import json
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sealbook.llm import common
from sealbook.llm.common import Known, Segments
from sealbook.llm.token_files import _cuts, kept_whole, read_token_files, write_token_files

ALPHABET = [*"aAbst'19 .,-_\n\t\r(", "  ", "\n\n", "\xa0", " ", "\x1c", "\x85", "é", "ß", "界", "🙂", "…", "'s", "'ll", "<|endoftext|>", "\0", "▁"]


def drawn(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["", *("".join(rnd.choices(ALPHABET, k=rnd.randrange(1, 25))) for _ in range(n))]


@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def coded(texts, cut, encode, whole=None, known=None):
    flat, bounds = Segments(pa.array(texts, pa.string()), cut, whole).coded(known or Known(), encode)
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_byte_level_segments_are_what_the_tokenizer_makes_of_whole_texts(byte_bpe):
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(byte_bpe)
    texts = drawn(4000, 1)

    def encode(segments):
        return [np.array(coder.encode(s.decode(), add_special_tokens=False).ids, np.uint32).tobytes() for s in segments]

    whole = pc.match_substring_regex(pa.array(texts), kept_whole(byte_bpe)).to_numpy(zero_copy_only=False)
    assert 0 < whole.sum() < len(texts)
    assert coded(texts, _cuts(), encode, whole) == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_cut_where_no_piece_reaches_over():
    import public_tokenizers
    import sentencepiece

    from sealbook.llm.sentencepieces import _encoder, load_vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = drawn(1500, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = [ids for b in _encoder(load_vocabulary(path))(iter([batch])) for ids in b.column("ids").to_pylist()]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i, t in enumerate(texts) if "\0" not in t]  # the library takes NUL for the end of some texts
    assert [got[i] for i in plain] == [model.encode(texts[i]) for i in plain]


def test_equal_hashes_do_not_make_segments_equal(monkeypatch):
    monkeypatch.setattr(common, "_run_hashes", lambda data, at, to: (to - at).astype(np.uint64) % np.uint64(2))
    texts = [" ab cd ab", "", "cd ab xyz", None]
    encode = lambda segments: [np.frombuffer(s, np.uint8).astype(np.uint32).tobytes() for s in segments]
    assert coded(texts, _cuts(), encode) == [list((t or "").encode()) for t in texts]


def test_known_segments_are_bounded_and_long_ones_not_kept():
    known, asked = Known(most=5000, longest=10), []

    def encode(segments):
        asked.extend(segments)
        return [s[:4].ljust(4) for s in segments]

    for k in range(0, 200, 5):
        known.look_up([b"%d" % i for i in range(k, k + 5)] + [b"x" * 11], encode)
        assert known.held <= 5000 and len(known.now) + len(known.before) <= 60
    assert len(asked) == 200 + 40
    assert known.look_up([b"199"], encode) == [b"199 "] and len(asked) == 240


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_tokenizers_encode_whole_texts(spark, byte_bpe, tmp_path, change):
    from tokenizers import Tokenizer

    other = json.dumps(json.loads(byte_bpe) | change)
    assert kept_whole(other) is None
    coder = Tokenizer.from_str(other)
    texts = ["One two,  Three\nFour", "", " A b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "t"), other)
    got = {r.doc_id: r.ids for r in read_token_files(spark, str(tmp_path / "t")).collect()}
    assert got == {i: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_segments_side_by_side_are_encoded_as_if_alone(byte_bpe):
    from tokenizers import Tokenizer

    from sealbook.llm.token_files import _side_by_side, _widths

    coder = Tokenizer.from_str(byte_bpe)
    rnd = random.Random(3)
    segments = [("".join([rnd.choice(["", " ", "\n", "  ", " \n"]), *rnd.choices("abtT's,.9éß界", k=rnd.randrange(1, 6)), rnd.choice(["", "", "", " "])])).encode() for _ in range(3000)]
    got = _side_by_side(segments, coder, _widths(coder))
    assert sum(ids is not None for ids in got) > 1000
    for s, ids in zip(segments, got):
        if ids is not None:
            assert np.frombuffer(ids, np.uint32).tolist() == coder.encode(s.decode(), add_special_tokens=False).ids
    assert all(ids is None for ids in _side_by_side(segments, coder, _widths(coder) + 1))  # widths that do not fit are noticed


def test_segments_in_use_are_encoded_once():
    known, asked = Known(), []
    encode = lambda segments: [asked.append(s) or s[-4:] for s in segments]
    for _ in range(2):
        for k in range(0, 400_000, 40_000):
            keys = [b"%08d" % i for i in range(k, k + 40_000)]
            assert known.look_up(keys, encode) == [key[-4:] for key in keys]
    assert len(asked) == 400_000
    assert sum(a.nbytes for pairs in (known.now, known.before) for a in vars(pairs).values()) < 64 * 400_000


def test_words_are_hashed_a_part_at_a_time(monkeypatch):
    sizes, run = [], common._run_hashes
    monkeypatch.setattr(common, "_run_hashes", lambda data, at, to: sizes.append(len(data)) or run(data, at, to))
    texts = ["".join(f"w{i} " for i in range(200_000)), None, "x" * 300_000, "w7 w8"]
    words = common.Words(pa.array(texts))
    assert max(sizes) <= 300_000 < len(texts[0])
    assert words.hashes.tolist() == run(words.joined, words.offsets[:-1], words.offsets[1:] - 1).tolist()
