"""Token counts and token ids with public tokenizer files.

Null texts count as empty. Repeated rows are each counted; nothing is sampled,
truncated or padded. Other columns of the input are ignored, so clashing names
cannot reach the output.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

#: Bytes of text handed to the tokenizer in one call.
BATCH_BYTES = 1 << 20
#: A longer text is encoded in parts that are cut at safe boundaries.
PART_CHARS = 1 << 17

_BEFORE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Characters that both encoders below class alike (letter, digit, space or
#: other); a test compares them one by one. Texts with others take the slow way.
_OTHERS = re.compile("[^\t\n\r -~¡-ɏ‐-‧‰-⁞₠-₿]")


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a text before single blanks that stand between non-blanks.

    A byte-level token never goes from a non-blank to a following blank, and
    what follows the blank is split without regard to what stands before it, so
    the parts' tokens are the text's tokens. A text without such a blank in
    reach gets longer parts.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        found = _BEFORE_BLANK.search(text, at + size)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


class Encoder:
    """Ids and counts for one tokenizer file.

    ``*.json`` is read by ``tokenizers``, ``*.model`` by ``sentencepiece``; no
    begin, end or other special tokens are added, and special strings inside a
    text are handled as the library does by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.pieces = None
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.path = path
        spec = self._spec()
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.normalized = bool(spec.get("normalizer"))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def _spec(self) -> dict:
        """The file's contents; tens of MB, so they are not kept."""
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    @functools.cached_property
    def tokenizer(self):
        """Loaded when a text asks for it; those of the other library don't."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        if self.pieces is not None:
            return self.pieces.encode(texts, num_threads=1)
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens; long texts are cut where the file allows it."""
        if self.pieces is not None or not self.byte_level:
            return [len(x) for x in self.encode_many(texts)]
        cut = [parts(x) for x in texts]
        lengths = [len(x) for x in self.tokenizer.encode_batch_fast([p for x in cut for p in x], add_special_tokens=False)]
        if len(lengths) == len(texts):
            return lengths
        at = np.cumsum([0] + [len(x) for x in cut])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return (total[at[1:]] - total[at[:-1]]).tolist()

    def _byte_pairs(self):
        """The same merges in the other library, about four times as fast.

        Built from the vocabulary of the same file; only for plain byte-level
        files, and only used for texts whose characters both class alike.
        """
        if self.fast is None:
            import tiktoken

            keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in keep}
            byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in self._spec()["model"]["vocab"].items() if t not in self.special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self.fast

    def ids(self, text: str) -> np.ndarray:
        if self.pieces is None and self.byte_level and not self.normalized and not _OTHERS.search(text) and not any(s in text for s in self.special):
            found = self._byte_pairs().encode_ordinary(text)
        elif self.pieces is None and self.byte_level:
            found = [i for ids in self.encode_many(parts(text)) for i in ids]
        else:
            found = self.encode_many([text])[0]
        return np.asarray(found, dtype="<u4")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def balanced(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about as many bytes each."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; only lengths leave Python.

    Null or empty text: 0 bytes and 0 tokens. Empty table: no rows. Repeated
    ids give repeated rows.
    """

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            column = batch.column(1)
            texts = (column.fill_null("") if column.null_count else column).to_pylist()
            n_bytes = np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in texts), np.int64, len(texts))
            n_tokens = np.zeros(len(texts), np.int64)
            for a, b in balanced(texts):
                n_tokens[a:b] = enc.counts(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
