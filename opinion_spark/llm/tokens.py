"""Token counts with a whole-token shortcut, and token ids for packing.

Pre-tokens are the pieces between which the tokenizer never merges. Which of them are one whole token is proved
offline, once per worker: every vocabulary string that can be a pre-token is encoded alone, and those that give
one id are kept. A text's pre-tokens found among those are counted directly; only the rest is merged, by the library's
own merges, and remembered per worker.

The shortcut replaces the library only where both are known to cut alike: texts without special-token strings, made of
characters for which normalising and cutting were compared with the library's own. Every other text is encoded
by the library whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Bytes, about, that a worker keeps of chunks and of pre-tokens it has seen, the first ones, which are the frequent ones. Longer
#: ones than REMEMBERED characters are not kept.
MEMORY, REMEMBERED = 48 << 20, 64
#: Vocabulary strings encoded at once: memory that they take together is not given back.
ENCODED_TOGETHER = 512
#: What an entry takes besides its characters.
_ENTRY = 220

#: Characters that the shortcut accepts: ASCII without the separators 1C-1F (blanks to one side, not to the other), and
#: the Latin letters that lower-case to one letter and compose to themselves.
PLAIN = regex.compile(r"[\x00-\x1B\x20-\x7F¡-¬®-įĲ-ňŊ-ž]*")
#: Fixed by the tokenizer file: how it cuts a text into pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Shortcut:
    """Ids and counts of texts for one tokenizer file; kept per worker by ``shortcut``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bytes_of = self._byte_letters()
        self.whole = self._whole_tokens()
        self.whole_ids = {s: array("I", [n]).tobytes() for s, n in self.whole.items()}
        #: Ids of pre-tokens, and of chunks where ids are asked for: a pre-token alone is a chunk with the same ids.
        self.string_ids: dict[str, bytes] = {}
        self.chunk_counts: dict[str, int] = {}
        self.held: dict[int, int] = {}

    def keep(self, memory: dict, key: str, value) -> None:
        """Remember a value within the bound."""
        if len(key) <= REMEMBERED:
            size = self.held.get(id(memory), 0) + _ENTRY + 4 * len(key)
            if size <= (2 * MEMORY if memory is self.string_ids else MEMORY):
                self.held[id(memory)] = size
                memory[key] = value

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}

    def _whole_tokens(self) -> dict[str, int]:
        back = {letter: byte for byte, letter in self.bytes_of.items()}
        strings = set()
        for entry in self.library.get_vocab(with_added_tokens=False):
            if entry.endswith("</w>"):
                try:
                    string = bytes(back[c] for c in entry[:-4]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if string.lower() == string and PRE_TOKEN.fullmatch(string) and PLAIN.fullmatch(string):
                    strings.add(string)
        listed = sorted(strings)
        out = {}
        for start in range(0, len(listed), ENCODED_TOGETHER):
            some = listed[start : start + ENCODED_TOGETHER]
            encoded = self.library.encode_batch_fast(some, add_special_tokens=False)
            out |= {s: e.ids[0] for s, e in zip(some, encoded, strict=True) if len(e.ids) == 1}
        return out

    @staticmethod
    def cut(chunk: str) -> list[str]:
        """The pre-tokens of a chunk without blanks. Letters alone, and letters before one ASCII mark, need no pattern."""
        low = chunk.lower()
        if low.isalpha():
            return [low]
        last = low[-1]
        if low[:-1].isalpha() and last.isascii() and not last.isdigit():
            return [low[:-1], last]
        return PRE_TOKEN.findall(low)

    def merged(self, pre_token: str) -> bytes:
        """Ids of a pre-token that is not one whole token, little-endian, four bytes each."""
        found = self.string_ids.get(pre_token)
        if found is None:
            # Letters, digits and marks of ASCII stand for themselves.
            plain = pre_token.isascii() and pre_token.isprintable()
            letters = pre_token if plain else "".join(map(self.bytes_of.__getitem__, pre_token.encode()))
            found = array("I", [t.id for t in self.library.model.tokenize(letters)]).tobytes()
            self.keep(self.string_ids, pre_token, found)
        return found

    def shortcut_applies(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def count(self, text: str) -> int:
        if not self.shortcut_applies(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        memory = self.chunk_counts
        chunks = text.split()
        counts = list(map(memory.get, chunks))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    pre = self.cut(chunks[i])
                    rest = [p for p in pre if p not in self.whole]
                    counts[i] = len(pre) - len(rest) + sum(len(self.merged(p)) for p in rest) // 4
                    self.keep(memory, chunks[i], counts[i])
        return sum(counts)

    def ids(self, text: str) -> bytes:
        """The text's ids, little-endian, four bytes each."""
        if not self.shortcut_applies(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memory, whole = self.string_ids, self.whole_ids
        chunks = text.split()
        parts = list(map(memory.get, chunks))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    pre = self.cut(chunks[i])
                    parts[i] = b"".join([whole[p] if p in whole else self.merged(p) for p in pre])
                    if pre[0] != chunks[i] or pre[0] in whole:
                        self.keep(memory, chunks[i], parts[i])
        return b"".join(parts)


@cache
def shortcut(path: str) -> Shortcut:
    return Shortcut(path)


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``. A NULL text is empty; rows are independent of each
    other, so repeated rows, ids and other columns play no part."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shortcut(path).count
        for batch in batches:
            for part in W.slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = np.diff(W.raw(part.column(1))[1])
                tokens = np.array([count(t) for t in texts], np.int64)
                columns = [part.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
