"""Problem 2: text read or written in the wrong character encoding.

Method as dealt: each swap of code pages is a substitution cipher, learned per source. Language
bigrams come from the well-formed words of the whole collection; for every source and cipher the
counts of successive cipher symbols are added up by Spark, and expectation-maximisation finds the
letters that the symbols stand for. Pairs of code pages known by name only give the starting values of a
cipher, and tell which words count for it; a cipher that no counts show has no table. Words that no such cipher explains count for a further cipher per source,
learned without starting values, and kept where most of these words then read naturally. The
tables are applied with translate(), and a word counts as garbled where the language model finds the
translated form natural and the stored form not.

What reaches the driver is bounded by alphabets, not by the data: bigrams of letters, and bigrams of
at most cfg.symbols symbols per source type and cipher, the rarer ones counted as one. The learned
tables go back as one small broadcast.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusline.functions.session import cut, spread


@dataclass(frozen=True)
class GarbleConfig:
    """natural: mean log-probability of a letter from which a word reads naturally; gain: by how much the
    translated form must be better; symbols: symbols of a cipher that are told apart (rarer ones are one symbol, which is
    not translated); support: occurrences from which a letter is learned against its starting value;
    neighbours: different symbols beside it, at least, better: by how much it must explain them better, in log-likelihood an occurrence; rounds: of the maximisation; starts: beginnings without starting values; pairs: symbol pairs from which a cipher without starting values is learned;
    words, believed: different words not learned from that it is tried on, at least, and the share of them that must then read naturally."""

    natural: float = -3.3
    gain: float = 1.0
    symbols: int = 300
    support: int = 30
    neighbours: int = 8
    better: float = 2.0
    rounds: int = 25
    starts: int = 8
    pairs: int = 200
    words: int = 10
    believed: float = 0.5
    other_source: str = "other"


# Alphabets of the languages, code pages by name, and signs of ordinary typography.
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN = "abcdefghijklmnopqrstuvwxyz"
GERMAN = "äöüß"
SIGNS = "«»„“”‘’–—…•№§°±²³·×−≤≥µ©®€"
CYRILLIC_PAGES = ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5")
WESTERN_PAGES = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850")

LETTERS = RUSSIAN + LATIN + GERMAN
INDEX = {c: n + 1 for n, c in enumerate(LETTERS)}
#: Row 0 is the edge of a word; the last row is any other letter.
SIZE = len(LETTERS) + 2
WORD = re.compile(r"[^\W\d_]+")
SHAPE = re.compile(rf"(?:[{RUSSIAN}]+|[{LATIN}{GERMAN}]+)\Z")
#: Damage that no writing has: replacement characters, control characters, letters lost to question marks.
CONTROLS = re.compile(r"[\x80-\x9f�]")
QUESTIONS = re.compile(r"\?{4,}|[^\W\d_]\?[^\W\d_](?!\S*[=/])|(?<![\w?])\?{2,}(?=[\s.,;:]+\?{2,})|(?<!\S)\?{3}(?=[ .,;])")
#: What may be letters under some single-byte cipher.
RUNS = re.compile(r"[^\x00-@\[-`{-\x7f]+")


def damaged(text: str) -> bool:
    return bool(CONTROLS.search(text) or "?" in text and QUESTIONS.search(text))

#: Signs where no writing has them: glued to letters, or a closing quotation mark before a letter.
MISPLACED = re.compile(r"(?<=[^\W\d_])[€©®µ‘“„](?=[^\W\d_]|\W|\Z)|[€©®](?=[^\W\d_])|(?:(?<=\s)|\A)[»”’](?=[^\W\d_])")
#: Signs inside words where writing has none.
INNER = re.compile(r"(?<=[^\W\d_])[^\w\s\-–—/.,:;()«»\"'’…&@+=|~^■>*](?=[^\W\d_])")
#: Characters of none of the alphabets, and no ordinary signs.
STRANGE = re.compile(rf"[^\x00-\x7f\xa0{RUSSIAN}{RUSSIAN.upper()}{GERMAN}{GERMAN.upper()}{re.escape(SIGNS)}]")
#: Evidence from which a text counts as garbled; what a wholly garbled word or multi-byte sign gives.
WHOLE = 3.0
#: A letter that leads a multi-byte symbol, beside a sign.
LEAD = re.compile(r"[РСВвÐÑÂÃâ╨╤т][^\w\s.,;:()/\-\"?!%=+]")


def decoded(page: str, byte: int) -> str:
    """The character a page shows for a byte; an unused byte shows as the control character of its number."""
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)


def shown(text: str, true: str, page: str) -> str:
    """What a reader of `page` sees of a text written in `true`."""
    return "".join(decoded(page, b) for b in text.encode(true, "replace"))


def priors() -> dict[str, dict[str, str]]:
    """name -> {cipher symbol: character} of every pair of code pages, and of UTF-8 read once or twice as one."""
    out: dict[str, dict[str, str]] = {}
    alphabet = RUSSIAN + RUSSIAN.upper() + GERMAN + GERMAN.upper() + "éèàáçñê" + SIGNS + "\xa0"
    for page in CYRILLIC_PAGES + WESTERN_PAGES:
        once = {shown(c, "utf-8", page): c for c in alphabet}
        out[f"utf-8>{page}"] = once
        if page in ("cp1251", "latin-1", "cp1252", "cp866"):
            out[f"utf-8>{page}>utf-8>{page}"] = {shown(k, "utf-8", page): c for k, c in once.items()}
    for true in (*CYRILLIC_PAGES, "cp1252"):
        for page in CYRILLIC_PAGES + WESTERN_PAGES:
            table = {decoded(page, b): decoded(true, b) for b in range(128, 256)}
            table = {k: v for k, v in table.items() if k != v}
            if true != page and sum(v.isalpha() for v in table.values()) > 40 and table not in out.values():
                out[f"{true}>{page}"] = table
    return out


def symbol_pattern(table: dict[str, str]) -> re.Pattern | None:
    """Matches one cipher symbol; None where symbols are single characters."""
    if all(len(k) == 1 for k in table):
        return None
    return re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))


@dataclass
class Cipher:
    """A table from symbols to characters, applied with str.translate or, for symbols of several characters, one pattern."""

    table: dict[str, str]
    pattern: re.Pattern | None = None
    single: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        self.pattern = symbol_pattern(self.table)
        self.single = {} if self.pattern else str.maketrans(self.table)
        self.heads = set("".join(self.table)) if not self.pattern else {k[0] for k in self.table}

    def apply(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.table[m[0]], text) if self.pattern else text.translate(self.single)

    def symbols(self, word: str) -> list[str]:
        if not self.pattern:
            return list(word)
        out, at = [], 0
        for m in self.pattern.finditer(word):
            out += word[at : m.start()]
            out.append(m[0])
            at = m.end()
        return out + list(word[at:])


def tokens_of(text: str) -> list[str]:
    """The runs between blanks, tabs and line ends; a no-break space is part of a token, as it may be part of a symbol."""
    return [t for t in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t]


def codes(word: str) -> list[int]:
    return [0, *(INDEX.get(c, SIZE - 1) for c in word.lower()), 0]


def language(bigrams: dict[str, int]) -> np.ndarray:
    """Joint probabilities of successive letters, smoothed; letters of no language are rare."""
    joint = np.full((SIZE, SIZE), 0.02)
    joint[SIZE - 1, :] = joint[:, SIZE - 1] = 1e-4
    scripts = [set(RUSSIAN), set(LATIN + GERMAN)]
    for a, x in enumerate(LETTERS):
        for b, y in enumerate(LETTERS):
            if not any(x in s and y in s for s in scripts):
                joint[a + 1, b + 1] = 1e-4
    for pair, n in bigrams.items():
        a, b = (0 if c == " " else INDEX[c] for c in pair)
        joint[a, b] += n
    joint[0, 0] = 1e-6
    return joint / joint.sum()


class Model:
    """Scores of words, and the verdict on a token, with what is learned."""

    def __init__(self, joint: np.ndarray, ciphers: dict[tuple[str, str], Cipher], cfg: GarbleConfig):
        self.joint, self.ciphers, self.cfg = joint, ciphers, cfg
        self.step = np.log(joint / joint.sum(axis=1, keepdims=True)).tolist()
        self.by_source: dict[str, list[tuple[str, Cipher]]] = defaultdict(list)
        for (source, name), cipher in ciphers.items():
            self.by_source[source].append((name, cipher))
        self.seen: dict[tuple[str, str], list[tuple[str, str, float]]] = {}
        self.spoilt: dict[tuple[str, str, str], bool] = {}
        self.scored: dict[str, float] = {}
        self.clean: dict[str, set[str]] = defaultdict(set)

    def score(self, text: str) -> float:
        """Mean log-probability of a letter of the token's words."""
        total = n = 0.0
        for word in WORD.findall(text):
            found = self.scored.get(word)
            if found is None:
                if len(self.scored) > 400_000:
                    self.scored.clear()
                own = codes(word)
                cased = not (word.islower() or word.isupper() or word[0].isupper() and word[1:].islower())
                found = self.scored[word] = sum(self.step[a][b] for a, b in zip(own, own[1:])) - 4.0 * cased
            total += found
            n += len(word) + 1
        return total / n if n else 0.0

    def odd(self, token: str) -> int:
        """Characters of no alphabet here, and neither digits nor ordinary signs."""
        return len(STRANGE.findall(token)) + len(MISPLACED.findall(token))

    def penalty(self, token: str) -> float:
        """score less what oddity costs: strange characters among or beside letters, and signs inside words."""
        inner = len(INNER.findall(token))
        return self.score(token) - 3.0 * (self.odd(token) + inner) / max(4, len(token))

    def readings(self, source: str, token: str) -> list[tuple[str, str, float]]:
        """(cipher, translated token, weight) of every cipher under which a token that looks wrong reads naturally, best first."""
        key = (source, token)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            found = self.seen[key] = [] if token.isascii() else self._readings(source, token)
        return found

    def _readings(self, source: str, token: str) -> list[tuple[str, str, float]]:
        own, odd = self.penalty(token), self.odd(token)
        if own >= self.cfg.natural and not odd and not LEAD.search(token):
            return []
        out = []
        chars = set(token)
        longest = max(map(len, RUNS.findall(token)), default=0)
        for name, cipher in self.by_source.get(source, ()):
            if chars.isdisjoint(cipher.heads) or longest < 3 and not cipher.pattern:
                continue
            text = cipher.apply(token)
            if text == token:
                continue
            letters = sum(c.isalpha() for c in text)
            # the score bounds what is left of it with the penalties
            if letters < 3 and not cipher.pattern or letters and self.score(text) < self.cfg.natural - (0.7 if cipher.pattern else 0.0):
                continue
            value = self.penalty(text) if letters else 0.0
            if cipher.pattern:
                # symbols that show: with strange characters, or letters beside signs inside them
                shows = sum(1 for m in cipher.pattern.finditer(token) if self.odd(m[0]) or not m[0].isalnum())
                if shows and self.odd(text) == 0 and (not letters or value >= self.cfg.natural - 0.7) and (odd or value > own or not letters):
                    out.append((value, name, text, WHOLE))
                elif letters >= 3 and value >= self.cfg.natural and value - own >= self.cfg.gain and not self.odd(text):
                    out.append((value, name, text, WHOLE if shows or letters >= 5 else 1.0))
            elif value >= self.cfg.natural and value - own >= (0.2 * self.cfg.gain if MISPLACED.search(token) and not self.odd(text) else self.cfg.gain):
                changed = sum(c in cipher.table for c in token if c.isalpha() or ord(c) > 127) / max(1, sum(c.isalpha() or ord(c) > 127 for c in token))
                out.append((value, name, text, WHOLE if changed > 0.6 and max(map(len, WORD.findall(text)), default=0) >= 5 else 1.0))
        return [x[1:] for x in sorted(out, key=lambda x: -round(x[0], 6))]

    def verdict(self, source: str, token: str) -> tuple[str, str] | None:
        """(cipher, translated token) of a token that looks wrong and that a cipher explains."""
        found = self.readings(source, token)
        return found[0][:2] if found else None

    def unread(self, token: str) -> bool:
        """Whether a token has letters, or what may stand for them, and reads far from naturally."""
        return bool(FOREIGN.search(token)) and self.penalty(token) < self.cfg.natural - 1.5

    def worse(self, source: str, name: str, token: str) -> bool:
        """Whether the cipher spoils a token that reads naturally as it is."""
        key = (source, name, token)
        found = self.spoilt.get(key)
        if found is None:
            if len(self.spoilt) > 400_000:
                self.spoilt.clear()
            text = self.ciphers[source, name].apply(token)
            found = self.spoilt[key] = text != token and self.penalty(text) < self.penalty(token) - 0.5
        return found

    def row(self, source: str, tokens: list[str], first: bool = False) -> set[str]:
        """The ciphers that a text shows: a run of tokens whose evidence for the cipher, less that against it, is enough.

        A foreign name that some cipher happens to explain stands among words that this cipher spoils.
        first: the first cipher with enough evidence will do.
        """
        clean = self.clean[source]
        suspects = [at for at, token in enumerate(tokens) if token not in clean]
        if not suspects:
            return set()
        gains: dict[str, dict[int, float]] = defaultdict(dict)
        for at in suspects:
            found = self.readings(source, tokens[at])
            if not found:
                if len(clean) > 1_000_000:
                    clean.clear()
                clean.add(tokens[at])
            elif first and found[0][2] >= WHOLE:
                return {found[0][0]}
            for name, _, weight in found:
                gains[name][at] = weight
        out: dict[str, float] = {}
        for name, own in gains.items():
            if len(own) == 1 and sum(own.values()) < WHOLE:
                continue
            best = run = 0.0
            met: set[str] = set()
            for at, token in enumerate(tokens):
                if at in own:
                    if token not in met:
                        met.add(token)
                        run += own[at]
                        best = max(best, run)
                elif not token.isascii() and self.worse(source, name, token):
                    run = max(0.0, run - 1.5)
                    if not run:
                        met.clear()
            if best >= WHOLE:
                out[name] = sum(own.values())
        most = max(out.values(), default=0)
        equal = sorted(name for name, value in out.items() if value == most)
        text = " ".join(tokens)
        return {max(equal, key=lambda name: self.penalty(self.ciphers[source, name].apply(text)))} if equal else set()


    def restored(self, source: str, text: str, names: set[str]) -> str:
        """The text with its garbled tokens translated.

        A cipher that spoils no token is applied to the whole text; else to the tokens that show it, and
        to short ones between two such.
        """
        for name in sorted(names):
            parts = re.split(r"([ \t\r\n]+)", text)
            own = parts[::2]
            if not any(self.worse(source, name, t) for t in own if not t.isascii()):
                text = self.ciphers[source, name].apply(text)
                continue
            fixed = [next((x for n, x, _ in self.readings(source, t) if n == name), None) for t in own]
            for at, t in enumerate(own):
                sides = fixed[max(0, at - 1) : at] + fixed[at + 1 : at + 2]
                if fixed[at] is not None:
                    parts[2 * at] = fixed[at]
                elif len(t) <= 6 and not t.isascii() and sides and None not in sides:
                    parts[2 * at] = self.ciphers[source, name].apply(t)
            text = "".join(parts)
        return text


def source_name(cfg: GarbleConfig):
    return F.coalesce("source_type", F.lit(cfg.other_source))


def token_counts(elements: DataFrame, cfg: GarbleConfig) -> DataFrame:
    """(source, token, n): tokens between blanks, added up over all elements; a null source is a source of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            rows = [(s, t, n) for s, own in counts.items() for t, n in own.items() if t]
            counts.clear()
            return pd.DataFrame(rows, columns=["source", "token", "n"])

        for batch in batches:
            for source, text in zip(batch.source, batch.text):
                counts[source].update(tokens_of(text))
            if sum(map(len, counts.values())) > 1_000_000:
                yield flush()
        if any(counts.values()):
            yield flush()

    rows = elements.filter(F.length("text") > 0).select(source_name(cfg).alias("source"), "text")
    return rows.mapInPandas(run, "source string, token string, n bigint").groupBy("source", "token").agg(F.sum("n").alias("n"))


def language_bigrams(tokens: DataFrame) -> dict[str, int]:
    """Counts of successive letters in well-formed words (one script, one of the usual cases); a blank is the edge of a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for token, n in zip(batch.token, batch.n):
                for word in WORD.findall(token):
                    low = word.lower()
                    if len(word) > 1 and SHAPE.match(low) and (word == low or word[1:] == low[1:]):
                        for a, b in zip(" " + low, low + " "):
                            counts[a + b] += n
            yield pd.DataFrame({"pair": list(counts), "n": list(counts.values())})

    found = tokens.select("token", "n").mapInPandas(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in found.collect()}  # at most SIZE ** 2 rows


#: The cipher without starting values, and the same learned from half of its words.
UNKNOWN, HALF = "unknown", "unknown half"
#: Stands for all symbols over cfg.symbols.
RARE = "\uffff"
#: Runs of characters that a single-byte page may show for letters.
FOREIGN = re.compile(r"[^\x00-\x7f]{4,}")


def held_out(token: str) -> bool:
    """Half of all words."""
    return xxhash.xxh3_64_intdigest(token) & 1 == 1


def cipher_words(tokens: DataFrame, joint: np.ndarray, cfg: GarbleConfig) -> DataFrame:
    """(source, cipher, a, b, n): counts of successive symbols in the words that a cipher's starting values explain best.

    Words that none explains count for the cipher without starting values; they follow as rows of their own,
    with b null, for the test of what is learned.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(joint)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ciphers = {("", name): Cipher(table) for name, table in priors().items()}
        model = Model(sent.value, ciphers, cfg)
        for batch in batches:
            counts: Counter = Counter()
            # each different word of a source counts once: an abbreviation or a foreign name that is frequent tells no more
            for source, token in zip(batch.source, batch.token):
                if token.isascii():
                    continue
                found = model.verdict("", token)
                if found:
                    name, words = found[0], [ciphers["", found[0]].symbols(token)]
                elif model.unread(token):
                    name, words = UNKNOWN, [list(run) for run in FOREIGN.findall(token)]
                    counts[source, name, token, None] += 1
                else:
                    continue
                names = (name, HALF) if name == UNKNOWN and not held_out(token) else (name,)
                for symbols in words:
                    edge = [x if len(x) > 1 or not x.isascii() else " " for x in symbols]
                    for a, b in zip([" ", *edge], [*edge, " "]):
                        if a != " " or b != " ":
                            for own in names:
                                counts[source, own, a, b] += 1
            rows = [(*k, n) for k, n in counts.items()]
            yield pd.DataFrame(rows, columns=["source", "cipher", "a", "b", "n"])

    return tokens.mapInPandas(run, "source string, cipher string, a string, b string, n bigint").groupBy("source", "cipher", "a", "b").agg(F.sum("n").alias("n"))


def cipher_bigrams(words: DataFrame, cfg: GarbleConfig) -> dict[tuple[str, str], dict[tuple[str, str], int]]:
    """(source, cipher) -> counts of successive symbols, of at most cfg.symbols symbols and RARE, so what is collected is bounded."""
    pairs = words.filter("b is not null")
    each = pairs.select("source", "cipher", F.explode(F.array("a", "b")).alias("symbol"), "n").groupBy("source", "cipher", "symbol").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source", "cipher").orderBy(F.desc("n"), "symbol"))
    often = each.withColumn("rank", rank).filter(F.col("rank") <= cfg.symbols).select("source", "cipher", "symbol")
    for side in ("a", "b"):
        named = often.select("source", "cipher", F.col("symbol").alias(side), F.lit(True).alias(f"told_{side}"))
        pairs = pairs.join(named, ["source", "cipher", side], "left")
    told = pairs.select("source", "cipher", *[F.when(F.col(f"told_{x}"), F.col(x)).otherwise(RARE).alias(x) for x in ("a", "b")], "n")
    out: dict[tuple[str, str], dict[tuple[str, str], int]] = defaultdict(dict)
    for r in told.groupBy("source", "cipher", "a", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.source, r.cipher][r.a, r.b] = r.n
    return out


def maximised(seen: np.ndarray, joint: np.ndarray, first: np.ndarray, strength: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(how often each letter shows as each symbol, the shares of a letter's symbols, log-likelihood) after so many rounds from `first`; strength: pseudo-counts of every round."""
    show = first / np.maximum(first.sum(axis=1, keepdims=True), 1e-12)
    expected, likelihood = np.zeros_like(show), -np.inf
    for _ in range(rounds):
        chance = np.maximum(show.T @ joint @ show, 1e-300)
        rate, likelihood = seen / chance, float((seen * np.log(chance)).sum())
        expected = show * (joint @ show @ rate.T) + show * (joint.T @ show @ rate)
        show = expected + strength
        show /= np.maximum(show.sum(axis=1, keepdims=True), 1e-12)
    return expected, show, likelihood


def learned(pairs: dict[tuple[str, str], int], start: dict[str, str], joint: np.ndarray, cfg: GarbleConfig) -> dict[str, str]:
    """The table found by expectation-maximisation from bigram counts of symbols; empty without rounds or counts.

    The model: successive letters follow the language's bigrams, each letter shows as a symbol. The
    E-step spreads each symbol bigram over the letter bigrams, the M-step re-estimates how letters show,
    with the starting table as pseudo-counts. A symbol gets the letter it stands for most; another than
    its starting letter needs cfg.support occurrences, nine tenths of them, several different neighbours, as a
    symbol of one word alone tells nothing, and neighbours that it explains much better. Symbols too rare
    to be learned, and signs, which no bigrams of letters tell apart, keep their start. Without a starting table several beginnings
    are tried, and the likeliest counts. Blanks and ASCII stand for themselves.
    """
    often: Counter = Counter()
    for (a, b), n in pairs.items():
        often[a] += n
        often[b] += n
    often.pop(" ", None)
    symbols = [" ", *(s for s, _ in sorted(often.items(), key=lambda x: (-x[1], x[0])))]
    at = {s: n for n, s in enumerate(symbols)}
    seen = np.zeros((len(symbols), len(symbols)))
    for (a, b), n in pairs.items():
        seen[at[a], at[b]] += n
    strength = np.full((SIZE, len(symbols)), 1e-3)
    strength[0, :] = strength[:, 0] = 0
    strength[0, 0] = 1
    if start:
        for n, s in enumerate(symbols[1:], 1):
            known = start.get(s)
            if known is not None and known.lower() in INDEX:
                strength[INDEX[known.lower()], n] += 5
            else:
                strength[SIZE - 1, n] += 1
        expected, show, _ = maximised(seen, joint, strength, strength, cfg.rounds)
    else:
        # letters as frequent as the symbol are likelier; of several such beginnings the one that explains the counts best
        letters = np.log(joint[1 : SIZE - 1].sum(axis=1) / joint[1 : SIZE - 1].sum())
        share = np.maximum(seen.sum(axis=0) + seen.sum(axis=1), 1e-9)[1:]
        near = np.exp(-((letters[:, None] - np.log(share / share.sum())[None, :]) ** 2)) * share / share.sum()
        tries = []
        for seed in range(cfg.starts):
            first = strength.copy()
            first[1 : SIZE - 1, 1:] += near * np.random.default_rng(seed).uniform(0.2, 1, near.shape)
            tries.append(maximised(seen, joint, first, strength, 2 * cfg.rounds))
        expected, show, _ = max(tries, key=lambda x: x[2])
    single = all(len(k) == 1 for k in start)
    # log-likelihood of a symbol's neighbours if it were that letter
    beside = joint @ show, joint.T @ show
    fit = np.log(np.maximum(beside[0], 1e-300)) @ seen.T + np.log(np.maximum(beside[1], 1e-300)) @ seen
    neighbours = (seen > 0).sum(axis=0) + (seen > 0).sum(axis=1)
    table = dict(start) if expected.any() else {}
    for n, s in enumerate(symbols[1:], 1):
        total, k, known = expected[:, n].sum(), int(expected[:, n].argmax()), start.get(s)
        if s == RARE or not total:
            continue
        sure = 0 < k < SIZE - 1 and expected[k, n] > (0.9 if start else 0.5) * total
        if start and known is None:
            sure = sure and single and total >= cfg.support and neighbours[n] >= cfg.neighbours
        elif known is not None and known.lower() in INDEX:
            sure = sure and total >= cfg.support and neighbours[n] >= cfg.neighbours and fit[k, n] - fit[INDEX[known.lower()], n] >= cfg.better * total
        if sure and (known is None or known.isalpha()):
            upper = known.isupper() if known else s.isupper() and s.lower() in at
            table[s] = LETTERS[k - 1].upper() if upper else LETTERS[k - 1]
        elif known is not None:
            table[s] = known
    for s in () if start else table:
        # capitals of few words follow their small letters
        if s.lower() != s and s.lower() in table and neighbours[at[s]] < cfg.neighbours:
            table[s] = table[s.lower()].upper()
    return {k: v for k, v in table.items() if k != v}


def believed(words: DataFrame, tables: dict[str, dict[str, str]], joint: np.ndarray, cfg: GarbleConfig) -> set[str]:
    """The sources whose cipher, learned from half of its words, makes enough of the other half read naturally. One row a source reaches the driver.

    Foreign names follow no cipher: a table that suits one half of them does not suit the other.
    """
    sent = words.sparkSession.sparkContext.broadcast((joint, tables))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joint, tables = sent.value
        model = Model(joint, {(s, HALF): Cipher(t) for s, t in tables.items()}, cfg)
        for batch in batches:
            rows = [(s, 1, int(bool(model.readings(s, t)))) for s, t in zip(batch.source, batch.a) if held_out(t)]
            yield pd.DataFrame(rows, columns=["source", "n", "read"])

    other = words.filter((F.col("cipher") == UNKNOWN) & F.col("b").isNull() & F.col("source").isin(*tables)).select("source", "a")
    found = other.mapInPandas(run, "source string, n bigint, read bigint").groupBy("source").agg(F.sum("n").alias("n"), F.sum("read").alias("read"))
    return {r.source for r in found.collect() if r.n >= cfg.words and r["read"] >= cfg.believed * r.n}


def learn(elements: DataFrame, cfg: GarbleConfig) -> Model:
    """The language and the ciphers of every source.

    What a cipher's symbols stand for is learned from the counts of all sources together, and from there
    on those of each source. A cipher that one source shows is a candidate in the others too.
    """
    tokens = cut(token_counts(elements, cfg))
    joint = language(language_bigrams(tokens))
    words = cut(cipher_words(tokens, joint, cfg))
    pairs = cipher_bigrams(words, cfg)
    sources = sorted({s for s, _ in pairs} | {r.source for r in tokens.select("source").distinct().collect()})
    known, pooled = priors(), defaultdict(Counter)
    for (_, name), own in pairs.items():
        pooled[name].update(own)
    general = {name: learned(own, known[name], joint, cfg) for name, own in pooled.items() if name in known}
    ciphers: dict[tuple[str, str], Cipher] = {}
    for source in sources:
        for name in sorted(general, key=lambda n: (-sum(pooled[n].values()), n)):
            own = pairs.get((source, name))
            table = {**general[name], **learned(own, general[name], joint, cfg)} if own and general[name] else general[name]
            if table:
                ciphers[source, name] = Cipher(table)
    enough = {s for (s, name), own in pairs.items() if name == UNKNOWN and sum(own.values()) >= cfg.pairs}
    halves = {s: learned(pairs[s, HALF], {}, joint, cfg) for s in sorted(enough) if (s, HALF) in pairs}
    for source in sorted(believed(words, halves, joint, cfg)) if halves else ():
        ciphers[source, UNKNOWN] = Cipher(learned(pairs[source, UNKNOWN], {}, joint, cfg))
    return Model(joint, ciphers, cfg)


def judged(elements: DataFrame, cfg: GarbleConfig, restore: bool) -> DataFrame:
    """(id, source_type, restored, cipher, whole) of the elements with garbled text, each id once.

    restored: the text with its garbled tokens translated (null unless asked for); whole: nothing lost
    remains in it; cipher: the ones applied, or `damage` where characters are lost.
    """
    source = spread(elements.select("id", "source_type", "text"))
    model = learn(source, cfg)
    sent = elements.sparkSession.sparkContext.broadcast((model.joint, {k: c.table for k, c in model.ciphers.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joint, tables = sent.value
        own = Model(joint, {k: Cipher(t) for k, t in tables.items()}, cfg)
        for batch in batches:
            rows = []
            for key, source, text in zip(batch.id, batch.source, batch.text):
                if text.isascii():
                    if damaged(text):
                        rows.append((key, source, text if restore else None, "damage", False))
                    continue
                names = own.row(source, tokens_of(text), not restore)
                lost = damaged(text)
                if not names and not lost:
                    continue
                fixed = own.restored(source, text, names) if restore else None
                rows.append((key, source, fixed, ", ".join(sorted(names)) or "damage", not damaged(fixed) if restore else not lost))
            yield pd.DataFrame(rows, columns=["id", "source_type", "restored", "cipher", "whole"])

    rows = source.filter(F.length("text") > 0).select("id", source_name(cfg).alias("source"), "text")
    return rows.mapInPandas(run, "id string, source_type string, restored string, cipher string, whole boolean").dropDuplicates(["id"])


def garbled_texts(elements: DataFrame, cfg: GarbleConfig = GarbleConfig()) -> DataFrame:
    """(id, source_type, cipher) of elements whose text is garbled, wholly or in part.

    elements: id, source_type, text; further columns are ignored. Null, empty and blank texts are no
    cases; a null source_type is learned as one source; repeated ids count once; an empty table gives
    no rows. Foreign letters and symbols written so are no case.
    """
    return judged(elements, cfg, False).select("id", "source_type", "cipher")


def restored_texts(elements: DataFrame, cfg: GarbleConfig = GarbleConfig()) -> DataFrame:
    """(id, source_type, cipher, restored, whole): the regained text of each affected element; whole is false where characters are lost."""
    return judged(elements, cfg, True)
