"""BPE encoding and decoding through a table of distinct words.

A batch of documents splits its texts into words and sends each distinct word once to the bucket of its hash.
The bucket gives each distinct word of the corpus once to the library and sends the ids back; the batch joins them
to its words by position. A word stands between white space and is as the text has it: the file's normaliser, its
pattern and its alphabet never reach across white space, so they work on the words as they would on the text. Decoding joins every id with its piece (a table as long as the vocabulary file).

The results are those of the tokenizers library for a file with this normaliser (NFC, one space for white
space, lower case), pre-tokeniser (split by pattern, byte alphabet) and no decoder; other files are refused.
Special tokens in a text keep their ids. Defined results: a null or empty text has no ids, and the hashes are
those of the empty string; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from rankloom.llm import blocks
from rankloom.llm.tables import width

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# White space as the file's patterns see it.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Words:
    """Splits texts at white space as the file's normaliser sees it."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        split, alphabet = data["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None or data["post_processor"] is not None or (
                split["behavior"], split["invert"], alphabet["use_regex"]) != ("Removed", True, False):
            raise ValueError(f"{file}: not a tokenizer of the supported form")
        self.run = re.compile(f"[^{SPACE}]+")
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in data["added_tokens"]) + ")")
        self.marks = [t["content"][:2] for t in data["added_tokens"]]

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space."""
        # str.split also parts at the separators U+001C to U+001F, which are no white space to the file.
        return self.run.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def split(self, text: str | None) -> list[str]:
        """Words in order; a special token is a word that begins with a space."""
        if not text:
            return []
        if not any(m in text for m in self.marks):
            return self.chunks(text)
        out: list[str] = []
        for k, piece in enumerate(self.special.split(text)):
            out.extend([" " + piece] if k % 2 else self.chunks(piece))
        return out


def _dealt(words: set[str], buckets: int) -> list[list[str]]:
    """The words of each bucket in alphabetical order."""
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in words:
        out[xxhash.xxh3_64_intdigest(w) % buckets].append(w)
    for part in out:
        part.sort()
    return out


def encode(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    buckets = 2 * width(docs.sparkSession)

    def vocabulary(batch: pa.Table) -> tuple[Words, list[list[str]]]:
        words, seen = Words(file), set()
        for t in batch.column("text"):
            seen.update(words.split(t.as_py()))
        return words, _dealt(seen, buckets)

    def forward(batch: pa.Table) -> Iterator[tuple[int, bytes]]:
        for b, part in enumerate(vocabulary(batch)[1]):
            if part:
                yield b, blocks.squeeze("\n".join(part).encode())

    def resolve(sent: list[bytes]) -> list[bytes]:
        tokenizer = Tokenizer.from_file(file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[str, list[int]] = {}

        def ids(word: str) -> list[int]:
            found = known.get(word)
            if found is None:
                found = [tokenizer.token_to_id(word[1:])] if word[0] == " " else tokenizer.encode(word, add_special_tokens=False).ids
                known[word] = found
            return found

        out = []
        for data in sent:
            each = [ids(w) for w in blocks.stretch(data).decode().split("\n")]
            head = np.array([len(each), *map(len, each)], np.uint32)
            out.append(blocks.squeeze(head.tobytes() + np.array(list(chain.from_iterable(each)), np.uint32).tobytes()))
        return out

    def finish(batch: pa.Table, answers: list[bytes]) -> pa.Table:
        words, dealt = vocabulary(batch)
        vocab = Tokenizer.from_file(file).get_vocab(with_added_tokens=True)
        pieces = dict(zip(vocab.values(), vocab.keys(), strict=True))
        as_ids: dict[str, str] = {}
        as_text: dict[str, str] = {}
        for own, data in zip([p for p in dealt if p], answers, strict=True):
            flat = np.frombuffer(blocks.stretch(data), np.uint32).tolist()
            if flat[0] != len(own):
                raise RuntimeError("answers do not match the batch's words")
            end = 1 + flat[0]
            for word, size in zip(own, flat[1:1 + flat[0]], strict=True):
                ids, end = flat[end:end + size], end + size
                as_ids[word], as_text[word] = " ".join(map(str, ids)), " ".join(map(pieces.__getitem__, ids))
        sizes, id_hash, text_hash = [], [], []
        for t in batch.column("text"):
            own = words.split(t.as_py())
            line = " ".join(map(as_ids.__getitem__, own))
            sizes.append(line.count(" ") + 1 if line else 0)
            id_hash.append(hashlib.sha256(line.encode()).hexdigest())
            text_hash.append(hashlib.sha256(" ".join(map(as_text.__getitem__, own)).encode()).hexdigest())
        return pa.table({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()),
                         "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())})

    return blocks.exchange(docs, doc_id, text, forward, resolve, finish, SCHEMA)


def query(docs: DataFrame, file: str | None = None) -> DataFrame:
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")
    return encode(docs.select("doc_id", "text"), str(file))
