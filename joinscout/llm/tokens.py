"""Token ids by the tokenizers library, with a bounded cache of words.

The vocabularies lower-case, drop white space and split before and after every run of letters and every digit, so the
ids of a text of plain letters, digits and ASCII punctuation are those of its runs, one after the other; runs seen
before come from a cache. Other texts are cut at blanks, and their pieces that aren't plain go to the library as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Letters whose lower case and normal form are one letter each, then ASCII punctuation without apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]*)([!-&(-/:-@\[-`{-~]*)\Z")
#: Anything but these, digits and ASCII white space; and the start of a special token, which stands for itself.
_ODD = r"[^A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž0-9!-&(-/:-@\[-`{-~ \t\n\r]|<\|"
#: Runs that split words: each ASCII digit, and runs of ASCII punctuation.
_SPLIT = r"([!-/:-@\[-`{-~]+|[0-9])"
PIECES, WORDS, LONGEST, AT_ONCE = 50_000, 400_000, 64, 4_000_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes. `split` says that pieces may be cached, `words` how many at most (twice that for a while)."""

    def __init__(self, path: str, split: bool = True, words: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.split = split
        self.most = words or WORDS
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends = np.zeros(0, bool)  # of each id, whether it ends a word
        if split:
            vocabulary = self.lib.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, taken together as one text, whose ids are cut where words end."""
        ids = np.array(self.lib.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(runs):
            return self._encode(runs)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _of_words(self, wanted: set[str]) -> dict[str, bytes]:
        """A dictionary that has all wanted words; words not used for long go when it is full."""
        if len(self.words) > self.most:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        missing = []
        for w in wanted.difference(words):
            if w in older:
                words[w] = older[w]
            else:
                missing.append(w)
        for at in range(0, len(missing), 2000):
            part = missing[at : at + 2000]
            words.update(zip(part, self._encode_runs(part), strict=True))
        return words

    def _add(self, missing: list[str], into: dict[str, bytes]) -> None:
        plain, odd = [], []
        for w in missing:
            m = _PLAIN.match(w) if len(w) <= LONGEST else None
            if m:
                plain.append((w, m[1].lower(), m[2]))
            else:
                odd.append(w)
        words = self._of_words({x for _, a, b in plain for x in (a, b) if x})
        for w, a, b in plain:
            into[w] = (words[a] if a else b"") + (words[b] if b else b"")
        for at in range(0, len(odd), 20_000):
            part = odd[at : at + 20_000]
            into.update(zip(part, self._encode(part), strict=True))

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of a list or an Arrow array; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.split:
            return self._encode([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
        rows = pc.fill_null(pc.cast(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), pa.large_string()), "")
        sizes = pc.binary_length(rows).to_numpy(zero_copy_only=False).tolist()
        out: list[bytes] = []
        at = 0
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= min(AT_ONCE, 10 * self.most)):
                size += sizes[end]
                end += 1
            part = rows.slice(at, end - at)
            odd = pc.match_substring_regex(part, _ODD)
            some = odd.to_numpy(zero_copy_only=False)
            if not some.any():
                out += self._plain(part)
            else:
                rest, plain = iter(self._odd(part.filter(odd).to_pylist())), iter(self._plain(part.filter(pc.invert(odd))))
                out += [next(rest if x else plain) for x in some]
            at = end
        del rows
        pa.default_memory_pool().release_unused()
        return out

    def _plain(self, texts) -> list[bytes]:
        """Ids of plain texts: their runs are looked up once a batch, and ids gathered by run."""
        import pyarrow.compute as pc

        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _SPLIT, r" \1 "))
        runs = cut.flatten().dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        words = self._of_words({w for w in distinct if w and len(w) <= LONGEST})
        of = [words[w] if 0 < len(w) <= LONGEST else self._encode([w])[0] for w in distinct]
        flat, n_of = np.frombuffer(b"".join(of), "<u4"), np.array([len(x) // 4 for x in of], np.int64)
        first, index = np.cumsum(n_of) - n_of, runs.indices.to_numpy()
        n = n_of[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = flat[np.arange(upto[-1]) + np.repeat(first[index] - upto[:-1], n)].tobytes()
        edges = (4 * upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()]).tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _odd(self, texts: list[str]) -> list[bytes]:
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*lists)
        missing = [w for w in wanted if w not in self.pieces]
        if len(self.pieces) + len(missing) > PIECES:
            self.pieces = {w: self.pieces[w] for w in wanted if w in self.pieces}
        self._add(missing, self.pieces)
        of = self.pieces
        return [b"".join([of[w] for w in ws]) for ws in lists]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, words: int | None = None) -> Encoder:
    """The encoder of this worker process, kept between its tasks."""
    if (path, words) not in _encoders:
        import json

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        _encoders[path, words] = Encoder(path, _splits_at_blanks(kind), words)
    return _encoders[path, words]


def _splits_at_blanks(kind: dict) -> bool:
    """True for the family that lower-cases, drops white space and ends words by a suffix."""
    norm = kind.get("normalizer") or {}
    steps = [x.get("type") for x in norm.get("normalizers", [norm])]
    return "Lowercase" in steps and (kind.get("model") or {}).get("end_of_word_suffix") == "</w>" and kind.get("post_processor") is None


def default_tokenizer() -> str:
    """Where the public word vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
