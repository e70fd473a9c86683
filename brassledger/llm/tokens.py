"""Token ids of whole texts with a public tokenizer file, fast and exact.

The tokenizer's normaliser and splitter never look across ASCII white space, so
a text's ids are its words' ids in a row, and words repeat. Each worker keeps
the ids of words it has met, packed, up to a bound. Unknown words go to the
tokenizers library many at a time: those of letters, with or without marks
behind them, without normaliser and offsets, as each then is a known number of
pieces whose last ids are marked as word ends; all others as one text, where
the offsets tell the words apart. Texts are split, and the words of a batch
made distinct, by Arrow; Python sees each distinct word of a batch once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Words that a worker remembers; about 60 MB.
CACHE_WORDS = 300_000
#: Texts in one Arrow batch: words repeat, so larger batches cost less a word.
TOKEN_ROWS = 1024
#: Words in one text for the tokenizer.
GROUP = 64
WORD_END = "</w>"
#: A lower-cased word of Latin letters (each is one code point in normal form C)
#: and the ASCII marks behind it. The splitter parts letters from marks.
_PLAIN = re.compile(r"([a-zß-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
#: Byte tables: ASCII white space becomes a blank; and A-Z become a-z.
_BLANKS = bytes(32 if 9 <= i <= 13 else i for i in range(256))
_LOWER = _BLANKS.lower()
_loaded: dict[str, tuple] = {}
_kinds: dict[str, str] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> tuple:
    """(tokenizer, the same for words in lower case, which ids end a word, known words)."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(whole.get_vocab_size(with_added_tokens=True), bool)
        ends[[i for word, i in whole.get_vocab(with_added_tokens=False).items() if word.endswith(WORD_END)]] = True
        _loaded[path] = (whole, plain, ends, {})
    return _loaded[path]


def id_type(path: str) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    if path in _kinds:
        return _kinds[path]
    top = max(_tokenizer(path)[0].get_vocab_size(with_added_tokens=True), END_ID + 1)
    return _kinds.setdefault(path, "<u2" if top <= 1 << 16 else "<u4")


def _cut(raw: bytes, cuts: Iterable[int]) -> list[bytes]:
    cuts = list(cuts)
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _plain_ids(pieces: list[str], plain, ends: np.ndarray, kind: str) -> list[bytes]:
    """Ids of pieces of letters only or marks only: one split of the text each."""
    groups = [" ".join(pieces[at : at + GROUP]) for at in range(0, len(pieces), GROUP)]
    ids = np.concatenate([np.array(e.ids, np.uint32) for e in plain.encode_batch_fast(groups, add_special_tokens=False)])
    cuts = (np.flatnonzero(ends[ids]) + 1) * np.dtype(kind).itemsize
    if len(cuts) != len(pieces):
        raise ValueError("the tokenizer does not mark the ends of words")
    return _cut(ids.astype(kind).tobytes(), [0, *cuts.tolist()])


def _learn(new: list[str], path: str) -> None:
    """Add unknown words."""
    whole, plain, ends, known = _tokenizer(path)
    kind = id_type(path)
    parts = [_PLAIN.fullmatch(w.lower()) for w in new]
    pieces = sorted({m[1] for m in parts if m} | {m[2] for m in parts if m and m[2]})
    ids = dict(zip(pieces, _plain_ids(pieces, plain, ends, kind), strict=True)) if pieces else {}
    rest = []
    for w, m in zip(new, parts, strict=True):
        if m:
            known[w] = ids[m[1]] + ids[m[2]] if m[2] else ids[m[1]]
        else:
            rest.append(w)
    if rest:
        starts = np.cumsum([0] + [len(w) + 1 for w in rest])
        got = whole.encode(" ".join(rest), add_special_tokens=False)
        begins = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
        cuts = np.searchsorted(begins, starts) * np.dtype(kind).itemsize  # a token is of the word in which it begins
        known.update(zip(rest, _cut(np.array(got.ids, kind).tobytes(), cuts.tolist()), strict=True))


def _mapped(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with each byte replaced by a table that changes ASCII only."""
    raw, ends = bytes_of(texts.cast(pa.large_binary()))
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes().translate(table))])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row, and where each value begins in
    them (and the last ends). Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def binary_column(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the pieces of ``raw`` between ``ends`` (in bytes)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _listed(words: pa.Array) -> list[str]:
    """A list of words, none of which holds a blank; faster than to_pylist."""
    if not len(words):
        return []
    with_blank = pc.binary_join_element_wise(words, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return with_blank.buffers()[2].to_pybytes().decode().split(" ")[: len(words)]


def encode_column(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text), each text with
    ``end_id`` behind it. Null is the empty text."""
    known, kind = _tokenizer(path)[3], id_type(path)
    if len(known) > CACHE_WORDS:
        known.clear()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    own = _mapped(texts, _LOWER)
    if (special := pc.match_substring(texts, "<|")).true_count:  # special tokens are looked for before lower-casing
        own = pc.if_else(special, _mapped(texts, _BLANKS), own)
    split = pc.split_pattern(own, " ")
    flat = split.flatten()
    word = pc.not_equal(flat, "")
    flat = flat.filter(word)
    coded = flat.dictionary_encode()
    distinct = _listed(coded.dictionary)
    ids = list(map(known.get, distinct))
    if None in ids:
        _learn([w for w, i in zip(distinct, ids, strict=True) if i is None], path)
        ids = list(map(known.__getitem__, distinct))
    width = np.dtype(kind).itemsize
    ids.append(b"" if end_id is None else np.array([end_id], kind).tobytes())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    starts = np.cumsum(sizes) - sizes
    # Where each text's words begin among all words.
    offsets = np.asarray(split.offsets).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])[offsets - offsets[0]].astype(np.int64)
    # The words of each text, then its end.
    order = np.full(len(flat) + len(texts), len(distinct), np.int64)
    order[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = coded.indices.to_numpy()
    each = sizes[order]
    before = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(starts[order] - before[:-1], each) + np.arange(before[-1])
    return np.frombuffer(b"".join(ids), kind)[at], np.diff(before[offsets + np.arange(len(offsets))])


def encode(texts: Iterable[str | None], path: str, end_id: int | None = END_ID) -> list[bytes]:
    """Each text's ids, then ``end_id``, as little-endian bytes of ``id_type``."""
    ids, sizes = encode_column(pa.array(list(texts), pa.large_string()), path, end_id)
    width = ids.dtype.itemsize
    return _cut(ids.tobytes(), np.concatenate([[0], np.cumsum(sizes) * width]).tolist())
