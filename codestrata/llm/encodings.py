"""Problem 10: text that was decoded with the wrong character encoding.

Wrong decoding turns one letter into a run of foreign ones. Every run of
letters outside ASCII is tried with every chain of (wrong encoding, right
encoding) steps up to ``MAX_STEPS``; candidates are compressed, with their
surroundings, by the zstandard dictionary of each language, and the candidate of
the least description length (compressed bytes plus the cost of its chain) wins;
otherwise the run stays as it is. A chain is paid once a text: where one has won,
other runs are undone the same way unless that is clearly longer. Text of older
encodings is sought on maximal stretches that the wrong encoding can hold.

Where bytes were lost, no chain is exact. Such a word or run is marked ``lost``
if a filled-in letter, or what can still be decoded, has a shorter description.

Dictionaries are trained on all labelled documents: each task condenses what it
has of a language to the stretches that recur most, and these are condensed
together until they fit the driver. Letters are counted in all of them. Null and
empty texts are never affected; every other row comes out, repaired or not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.prose import LANGUAGES
from codestrata.shared import keep

#: Encodings that texts are taken for by mistake; ``sloppy-1252`` passes undefined bytes through.
WRONG = ("sloppy-1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman")
#: Fixed values: (taken for, really) pairs of older encodings.
LEGACY = (
    *(("sloppy-1252", e) for e in ("cp1251", "koi8_r", "cp866", "shift_jis", "gb18030", "euc_jp", "big5")),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"),
)
#: Bytes that a step of a chain costs, steps at most, letters of context on each side, bytes of a dictionary.
STEP_COST, LOSS_COST, MAX_STEPS, CONTEXT, DICTIONARY = 0.5, 1.0, 6, 48, 16_384
#: Bytes by which the lengths of two short texts differ by chance: a chain that a text has paid for is left only for more.
NOISE = 2.0
#: Letters that a run of legacy text has at least, and how many bytes it must save.
LEGACY_RUN, LEGACY_GAIN = 6, 4
#: Rounds in which garbled documents are looked for in the sample, each with dictionaries of what the last one left; a second one changes nothing here.
CLEANINGS = 1

#: Bytes that more text of a language is condensed to; bytes of text that a task gathers before it condenses them; condensed blocks that are condensed together.
CONDENSED, GATHERED, FAN_IN = 524_288, 16 << 20, 16
#: Bytes at the beginning of a trained dictionary that can be tables of codes.
TABLES = 512

_RUN = re.compile(r"[^\x00-\x7f]+")
_CLAUSE = re.compile(r"[^.!?。\n]+[.!?。]?")
_SENTENCE = re.compile(r"(?<=[.!?。])\s*|\n+")
_LOST = re.compile(r"(?<=\w)�+(?=\w)|(?<=\w)�+|�+(?=\w)")
#: Frequent letters outside ASCII, which are filled in where a byte was lost.
_FILL = "éèàçãõáíóúñöüäßêâôîд的のệ"
#: Words in two scripts: their lines are tried, the description lengths decide.
_TWO_SCRIPTS = re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_EASTERN = re.compile("[\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef]")
#: Languages in Latin letters.
_LATIN = tuple(x for x in LANGUAGES if x not in ("ru", "zh", "ja"))
_WESTERN = re.compile("[\u0080-ÿ‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]")
#: Letters that start garbled sequences: UTF-8 lead bytes as the usual wrong encodings show them, with what may follow.
_SPECIAL = "\u0080-¿‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸƒ€"
_BROKEN = re.compile(f"[ÂÃâÄÅÐÑ][{_SPECIAL}]")


def letters(encoding: str) -> list[str]:
    """What each byte from 0x80 on looks like in a single-byte encoding; undefined bytes pass through as C1 controls."""
    out = []
    for byte in range(0x80, 0x100):
        try:
            out.append(bytes([byte]).decode("cp1252" if encoding == "sloppy-1252" else encoding))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return out


def sequence_pattern(encoding: str) -> re.Pattern[str]:
    """Matches what well-formed UTF-8 sequences outside ASCII look like in a single-byte encoding."""
    table = letters(encoding)

    def group(first: int, last: int) -> str:
        return "[" + "".join(re.escape(c) for c in table[first - 0x80 : last - 0x7F]) + "]"

    follow = group(0x80, 0xBF)
    return re.compile(f"(?:{group(0xC2, 0xDF)}{follow}|{group(0xE0, 0xEF)}{follow}{{2}}|{group(0xF0, 0xF4)}{follow}{{3}})+")


class Codec:
    """A single-byte encoding: the look of UTF-8 in it, and the way back."""

    def __init__(self, encoding: str):
        self.name = encoding
        self.pattern = sequence_pattern(encoding)
        table = letters(encoding)
        self.bytes = {c: 0x80 + i for i, c in enumerate(table)}
        self.first, self.follow = frozenset(table[0x42:0x75]), frozenset(table[:0x40])

    def undo(self, text: str) -> str | None:
        try:
            return bytes(self.bytes[c] if c > "\x7f" else ord(c) for c in text).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None


CODECS = tuple(Codec(e) for e in WRONG)
BYTES = {e: Codec(e).bytes for e in {*WRONG, *(w for w, _ in LEGACY)}}
NAMED = {c.name: c for c in CODECS}


LEGACY_BY_WRONG = {w: tuple(r for x, r in LEGACY if x == w) for w in dict.fromkeys(w for w, _ in LEGACY)}
#: Maximal stretches of a line that a wrong encoding can hold, from their first letter outside ASCII to their last.
STRETCH = {
    w: re.compile(f"[{''.join(map(re.escape, BYTES[w]))}](?:[\\x00-\\x09\\x0b-\\x7f{''.join(map(re.escape, BYTES[w]))}]*[{''.join(map(re.escape, BYTES[w]))}])?")
    for w in LEGACY_BY_WRONG
}


def chains(text: str, depth: int = MAX_STEPS) -> list[tuple[tuple[str, ...], str]]:
    """Every (chain of encodings, text) that a garbled snippet can be decoded to, itself first."""
    found: dict[str, tuple[str, ...]] = {text: ()}
    level = [text]
    for _ in range(depth):
        following = []
        for t in level:
            for codec in CODECS:
                fixed = codec.pattern.sub(lambda m, c=codec: c.undo(m[0]) or m[0], t)
                if fixed not in found:
                    found[fixed] = (*found[t], codec.name)
                    following.append(fixed)
        level = following
    return [(chain, t) for t, chain in found.items()]


def spans(text: str) -> list[tuple[int, int]]:
    """Maximal stretches of letters outside ASCII that hold garbled sequences of any encoding."""
    held = {c for c in set(text) if c > "\x7f"}
    found = sorted(m.span() for codec in CODECS if not codec.first.isdisjoint(held) and not codec.follow.isdisjoint(held) for m in codec.pattern.finditer(text))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and b <= out[-1][1]:
            continue
        run = _RUN.match(text, b)
        b = run.end() if run else b
        while a > 0 and text[a - 1] > "\x7f" and (not out or a > out[-1][1]):
            a -= 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def undo(chain: tuple[str, ...], text: str) -> str | None:
    """``text`` after every step of a chain; None if a step finds nothing to undo."""
    for name in chain:
        codec = NAMED[name]
        fixed = codec.pattern.sub(lambda m, c=codec: c.undo(m[0]) or m[0], text)
        if fixed == text:
            return None
        text = fixed
    return text


class Lengths:
    """Description lengths: the least of the languages that write in the scripts of a text.

    A dictionary of another script holds nothing that a letter outside ASCII could be copied from.
    """

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.compressors = {
            lang: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
            for lang, raw in dictionaries.items()
        }

    def __call__(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        cyrillic, eastern = bool(_CYRILLIC.search(text)), bool(_EASTERN.search(text))
        langs = ("en", "ru") * cyrillic + ("en", "zh", "ja") * eastern + _LATIN * (not (cyrillic or eastern))
        lengths = [len(self.compressors[x].compress(raw)) for x in dict.fromkeys(langs) if x in self.compressors]
        return min(lengths) if lengths else min((len(c.compress(raw)) for c in self.compressors.values()), default=len(raw))


def sentences(text: str) -> list[str]:
    return [p for p in _SENTENCE.split(text) if len(p) > 8]


def condensed(texts: list[str], size: int = CONDENSED) -> list[str]:
    """The texts, or, where they take more than ``size`` bytes, the stretches of all of them that recur most.

    Half of the size is for sentences with letters outside ASCII, which are few in English.
    """
    import zstandard

    if sum(map(len, texts)) <= size and sum(len(t.encode("utf-8", "replace")) for t in texts) <= size:
        return texts
    out = []
    parts = [p for t in texts for p in _CLAUSE.findall(t) if len(p) > 8]
    for part in ([p for p in parts if p.isascii()], [p for p in parts if not p.isascii()]):
        raw = [f"{p.strip()}\n".encode("utf-8", "replace") for p in part]
        if sum(map(len, raw)) > size // 2:
            try:
                raw = [zstandard.train_dictionary(size // 2, raw, k=200, d=8).as_bytes()[TABLES:]]
            except zstandard.ZstdError:  # too few sentences to find what recurs
                pass
        out += sentences(b"".join(raw).decode("utf-8", "ignore"))
    return out


def train_dictionaries(samples: list[tuple[str, str]], size: int = DICTIONARY) -> dict[str, bytes]:
    """A zstandard dictionary for each language of the sample; raw text stands in where there is too little to train on."""
    import zstandard

    out = {}
    for lang in LANGUAGES:
        texts = [t for x, t in samples if x == lang and t and not _BROKEN.search(t) and "�" not in t]
        parts = [p.encode("utf-8", "replace") for t in texts for p in sentences(t)]
        if not parts:
            continue
        try:
            out[lang] = zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:
            out[lang] = b"\n".join(parts)[:size]
    return out


def without_garbled(samples: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The sample without texts that hold garbled passages; each half is judged by the other's dictionaries."""
    left = samples
    for _ in range(CLEANINGS):
        judges = [Repairer(train_dictionaries(left[1 - k :: 2]), frozenset()) for k in (0, 1)]
        left = [(x, t) for i, (x, t) in enumerate(samples) if not t or t.isascii() or not judges[i % 2](t)[1]]
    return left


class Repairer:
    def __init__(self, dictionaries: dict[str, bytes], common: frozenset[str]):
        self.length = Lengths(dictionaries)
        letter = f"[^\\x00-\\x7f{re.escape(''.join(sorted(common)))}]"
        self.common = frozenset({*map(chr, range(128)), *(c for c in common if not _CYRILLIC.match(c))})
        self.rare = re.compile(f"[A-Za-z]{letter}|{letter}[A-Za-z]")
        self.options = lru_cache(maxsize=20_000)(chains)

    def snippet(self, before: str, garbled: str, after: str) -> tuple[tuple[str, ...], str]:
        """The best (chain, text) for a snippet between its surroundings."""
        options = self.options(garbled)
        if len(options) == 1:
            return options[0]
        return min(options, key=lambda o: (self.within(before, o[0], o[1], after) + STEP_COST * len(o[0]), len(o[0])))

    def within(self, before: str, chain: tuple[str, ...], text: str, after: str) -> int:
        """The length of a candidate between its surroundings, of which what follows is undone by the same chain where it can be."""
        return self.length(before + text + ((undo(chain, after) if chain else None) or after))

    def __call__(self, text: str | None) -> tuple[str | None, list[str]]:
        """(text as far as it can be restored, distinct chains used, ``lost`` where bytes are missing)."""
        if not text or text.isascii():
            return text, []
        used: set[str] = set()
        text, legacy = self.legacy(text)
        used |= legacy
        found, at, fixed = spans(text), 0, ""
        picked = []
        for a, b in found:
            fixed += text[at:a]
            before, after = fixed[-CONTEXT:], text[b : b + CONTEXT]
            chain, mended = self.snippet(before, text[a:b], after)
            picked.append((chain, mended, before, after))
            fixed += mended
            at = b
        known = Counter(c for c, *_ in picked if c).most_common(1)
        out, at = [], 0
        for (a, b), (chain, mended, before, after) in zip(found, picked, strict=True):
            if known and chain != known[0][0] and (same := undo(known[0][0], text[a:b])) is not None:
                cost = self.within(before, chain, mended, after) + STEP_COST * len(chain)
                if self.within(before, known[0][0], same, after) <= cost + NOISE:  # the text has paid for this chain elsewhere
                    chain, mended = known[0][0], same
            if not chain and self._partly(before, text[a:b], after):
                used.add("lost")
            out += [text[at:a], mended]
            at = b
        fixed = "".join([*out, text[at:]])
        used |= {">".join(c) for c, *_ in picked if c}
        fixed, legacy = self._western(fixed)
        used |= legacy
        if "�" in fixed and any(self._lost_letter(fixed, m) for m in _LOST.finditer(fixed)):
            used.add("lost")
        return fixed, sorted(used)

    def _lost_letter(self, text: str, m: re.Match[str]) -> bool:
        """Whether a frequent letter in the place of lost bytes has a shorter description."""
        before, after = text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]
        least = self.length(before + m[0] + after) - LOSS_COST
        return any(self.length(before + c + after) <= least for c in _FILL)

    def _partly(self, before: str, garbled: str, after: str) -> bool:
        """Whether what some encoding can still decode of a run that no chain undoes has a shorter description."""
        least = self.length(before + garbled + after) - LOSS_COST - STEP_COST
        for codec in CODECS:
            if codec.first.isdisjoint(garbled):
                continue
            raw = bytes(codec.bytes.get(c, 0xFF) if c > "\x7f" else ord(c) for c in garbled)
            rest = raw.decode("utf-8", "replace")
            if rest.strip("�") and self.length(before + rest.replace("�", "") + after) <= least:
                return True
        return False

    def _western(self, text: str) -> tuple[str, set[str]]:
        """Lines of a western language whose accents were read in another single-byte encoding."""
        used: set[str] = set()

        def mend(line: str) -> str:
            if self.common.issuperset(line) or not (self.rare.search(line) or _TWO_SCRIPTS.search(line)):
                return line
            best, name, least = line, "", self.length(line) - 2
            for wrong in ("mac_roman", "cp1251", "cp1250", "cp437", "koi8_r"):
                try:
                    other = bytes(BYTES[wrong][c] if c > "\x7f" else ord(c) for c in line).decode("cp1252")
                except (KeyError, UnicodeDecodeError):
                    continue
                if (n := self.length(other) + STEP_COST) < least:
                    best, name, least = other, f"{wrong}:cp1252", n
            if name:
                used.add(name)
            return best

        return "\n".join(line if line.isascii() else mend(line) for line in text.split("\n")), used

    def legacy(self, text: str) -> tuple[str, set[str]]:
        """Stretches of foreign letters that are text of an older encoding."""
        used: set[str] = set()
        held = {c for c in set(text) if c > "\x7f"}
        for wrong, rights in LEGACY_BY_WRONG.items():
            if BYTES[wrong].keys().isdisjoint(held):
                continue
            text = STRETCH[wrong].sub(lambda m, w=wrong, r=rights: self._stretch(m[0], w, r, used), text)
        return text, used

    def _stretch(self, passage: str, wrong: str, rights: tuple[str, ...], used: set[str]) -> str:
        foreign = _CYRILLIC.findall(passage) or _WESTERN.findall(passage)
        if len(foreign) < LEGACY_RUN or len(foreign) < 0.3 * len(passage):
            return passage
        if any(sum(len(x) for x in CODECS[k].pattern.findall(passage)) > 0.5 * len(foreign) for k in (0, 1)):
            return passage
        raw = bytes(BYTES[wrong][c] if c > "\x7f" else ord(c) for c in passage)
        best, name, least = passage, "", math.inf
        for right in rights:
            try:
                other = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if least == math.inf:
                least = self.length(passage) - max(LEGACY_GAIN, len(passage) // 8)
            if (n := self.length(other) + STEP_COST) < least:
                best, name, least = other, f"{wrong}:{right}", n
        if name and any((t := undo((c.name,), passage)) is not None and self.length(t) + STEP_COST <= least for c in CODECS):
            return passage  # it is rather UTF-8, whose sequences are undone later
        if name:
            used.add(name)
        return best


def frequent(counts: Counter[str], texts: int) -> set[str]:
    """Letters outside ASCII that at least one in fifty of the texts holds."""
    return {c for c, n in counts.items() if c > "\x7f" and n * 50 >= texts}


def common_letters(samples: list[tuple[str, str]]) -> frozenset[str]:
    """Letters outside ASCII that at least one in fifty texts of some language holds."""
    out: set[str] = set()
    for lang in LANGUAGES:
        texts = [set(t) for x, t in samples if x == lang and t]
        out |= frequent(Counter(c for t in texts for c in t), len(texts))
    return frozenset(out)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a task has of each language: its texts, condensed, and how many of them hold each letter ('' counts the texts)."""
    from pyspark import TaskContext

    texts: dict[str, list[str]] = {}
    held: dict[str, int] = Counter()
    letters: dict[str, Counter[str]] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            count = letters.setdefault(lang, Counter())
            count[""] += 1
            if not text.isascii():
                count.update(c for c in set(text) if c > "\x7f")
                if "�" in text or _BROKEN.search(text):
                    continue
            texts.setdefault(lang, []).append(text)
            held[lang] += len(text)
            if held[lang] > GATHERED:
                texts[lang] = condensed(texts[lang])
                held[lang] = sum(map(len, texts[lang]))
    block = TaskContext.get().partitionId()
    rows = [(x, block, condensed(texts.get(x, [])), [{"letter": c, "n": n} for c, n in sorted(counts.items())]) for x, counts in letters.items()]
    yield pd.DataFrame(rows, columns=["lang", "block", "texts", "letters"])


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    texts = condensed([t for block in pdf["texts"] for t in block])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "block": [int(pdf["block"].iloc[0]) // FAN_IN], "texts": [texts]})


def fitted(documents: DataFrame) -> tuple[dict[str, bytes], frozenset[str]]:
    """Dictionaries and common letters of all labelled documents.

    The driver gets one condensed block of each language, and its letters.
    """
    labelled = documents.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull() & (F.col("text") != "")).select("lang", "text")
    gathered = keep(labelled.mapInPandas(_gathered, "lang string, block bigint, texts array<string>, letters array<struct<letter:string,n:bigint>>"), "texts", tidy=True)
    counts: dict[str, Counter[str]] = {}
    for r in gathered.select("lang", F.inline("letters")).groupBy("lang", "letter").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.lang, Counter())[r.letter] = r.n
    common = frozenset(c for count in counts.values() for c in frequent(count, count[""]))
    blocks = gathered.select("lang", "block", "texts")
    last = blocks.agg(F.max("block")).first()[0] or 0
    while last > 0:
        blocks = blocks.groupBy("lang", F.floor(F.col("block") / FAN_IN).alias("of")).applyInPandas(_joined, "lang string, block bigint, texts array<string>")
        last //= FAN_IN
    samples = [(r.lang, t) for r in sorted(blocks.collect(), key=lambda r: (r.lang, r.block)) for t in r.texts]
    return train_dictionaries(without_garbled(samples)), common


def repaired_texts(documents: DataFrame, model: tuple[dict[str, bytes], frozenset[str]]) -> DataFrame:
    """(doc_id, repaired, chains array<string>): documents with at least one garbled passage, as far as they can be restored.

    Map-only: texts of ASCII never leave the JVM, no row is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mend = Repairer(*shared.value)
        for b in batches:
            out = [(i, *mend(t)) for i, t in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame([o for o in out if o[2]], columns=["doc_id", "repaired", "chains"])

    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").where(~F.col("text").rlike(r"^\p{ASCII}*$"))
    return texts.select("doc_id", "text").mapInPandas(rows, "doc_id bigint, repaired string, chains array<string>")
