"""From text as written to words as meant: the spelling transducer.

Control sequences, invisible characters and doubly encoded letters are undone,
look-alike letters of other scripts are mapped, accents drop. A word is then
looked up in a lexicon as it stands, with repeated letters folded, with digits
and signs read as letters, with masked letters, spelled out letter by letter,
cut by a stray blank or merged with its neighbour, and with one slip of the
keyboard. Each reading has a cost; words outside the lexicon have none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("аеіорсухѕјԁһкмтвнгпαορνικτυ", "aeiopcyxsjdhkmtbhrnaopviktu")
#: Digits and signs that stand for letters (fixed values); a sign may stand for any letter.
DIGIT_LETTERS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = "*#%$@!&+"
#: Signs that end a clause; so does the end of a line or text.
ENDS = ("", *".!?;。！？；")

_ESCAPES = re.compile(r"\x1b\[[0-9;]*[A-Za-z]|<\|[a-z]+\|>|&#?\w{2,6};|</?[a-z]{1,6}>")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_DOUBLE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")
_COMBINING = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))) + "]")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_](?:[ ._\-]|\. )){3,}[^\W\d_](?![^\W_])")
_CLAUSE = re.compile(r"(?<=[.!?;])\s+|\n+|[。！？；]+|(?<=\.\.)\s*")
_WRAP = re.compile(r"""\n(?=(?:>|[#*/|]+[ \t]|[ \t])*["'(\[“‘«„]*([^\W\d_]))""")
_MARGIN = re.compile(r"(?:>|[#*/|]+[ \t]|[ \t])*")
_TOKEN = re.compile(r"[\w*#%$@!&+]+")
_PAUSE = re.compile(r"[,:()\"“”«»—–]|(?<!\w)-(?!\w)|[.!?;]+(?=\s)")
_QUOTE = re.compile("[\"“”«»„]")
#: Scripts written without blanks between words, after decomposition (fixed ranges).
_UNSPACED = re.compile("[\u1100-\u11ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]+")


def _redecode(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m[0]


def plain(text: str) -> str:
    """Lower-case text without escapes, invisible characters and accents."""
    if text.isascii():
        if "\x1b" in text or "<" in text or "&" in text or not text.isprintable():
            text = _INVISIBLE.sub("", _ESCAPES.sub("", text))
        return text.lower()
    text = _INVISIBLE.sub("", _ESCAPES.sub("", text))
    for _ in range(2):
        if "Ã" in text or "Â" in text or "â" in text or "Ð" in text or "Ñ" in text:
            text = _DOUBLE.sub(_redecode, text)
    text = unicodedata.normalize("NFKD", text).lower().replace("ß", "ss").replace("ı", "i").replace("ł", "l").replace("ø", "o")
    return _COMBINING.sub("", text)


def clauses(text: str) -> Iterable[str]:
    return (c for c in _CLAUSE.split(text) if c and not c.isspace())


def wrapped(text: str, meant: str) -> Iterable[list[str]]:
    """Parts of each clause of ``meant``, the plain form of ``text``, that runs over line ends.

    It does where a line ends without a sentence sign and the next one begins
    with a letter that is no capital; margins of quotes and comments drop.
    """
    lines: list[str] = []
    run: list[str] = []
    following: list[str] = []
    k = at = 0
    last = -2
    for m in _WRAP.finditer(text):
        k += text.count("\n", at, m.start())
        at = m.start()
        if m[1].isupper() or m[1].istitle():
            continue
        lines = lines or meant.split("\n")
        if lines[k].rstrip()[-1:] in ENDS:
            continue
        own = following if k == last + 1 else list(clauses(_MARGIN.sub("", lines[k], count=1)))
        following = list(clauses(_MARGIN.sub("", lines[k + 1], count=1)))
        ran_on, last = k == last + 1, k
        if not own or not following:
            continue
        if not ran_on or len(own) > 1 or not run:
            if run:
                yield run
            run = [own[-1].strip()]
        run.append(following[0].strip())
    if run:
        yield run


def pieces(parts: list[str], words: int = 512, shared: int = 128) -> Iterable[str]:
    """Joined parts in pieces of about ``words`` tokens; neighbours share ``shared``, more than any machine reads, and a part at least."""
    if sum(map(len, parts)) < words:
        yield " ".join(parts)
        return
    sizes = [len(tokens_of(p)) for p in parts]
    a = 0
    while True:
        b, n = a, 0
        while b < len(parts) and (n < words or b < a + 2):
            n += sizes[b]
            b += 1
        yield " ".join(parts[a:b])
        if b == len(parts):
            return
        c, n = b - 1, sizes[b - 1]
        while n < shared and c > a + 1:
            c -= 1
            n += sizes[c]
        a = c


def tokens_of(clause: str) -> list[str]:
    return _TOKEN.findall(clause)


def is_unspaced(text: str) -> bool:
    """Whether a text holds words of a script without blanks."""
    return not text.isascii() and _UNSPACED.search(text) is not None


def letter_by_letter(tokens: list[str]) -> bool:
    """Whether a word may be spelled out: single letters in a row, or between underscores."""
    run = 0
    for t in tokens:
        run = run + 1 if len(t) == 1 else 0
        if run == 4 or "_" in t and 2 * t.count("_") + 2 >= len(t) > 6:
            return True
    return False


def folded(word: str) -> str:
    """Runs of a letter become one."""
    return re.sub(r"(.)\1+", r"\1", word)


def _one_slip(a: str, b: str) -> bool:
    """Equal but for a letter swapped with the next or, in longer words, one added, lost or changed."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return len(a) > 6 and a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return len(b) > 6 and a[i:] == b[i + 1 :]


class Lexicon:
    """word -> symbols; ``read`` gives the symbols of a written word with their costs."""

    LETTERS, SLIP, SPELLED = 0.05, 0.15, 0.05

    def __init__(self, words: dict[str, set[str]], slips_from: int = 5, remembered: int = 300_000, guess: Callable[[str], dict[str, float]] = lambda token: {}):
        """``guess`` gives the symbols of words outside the lexicon by their form."""
        self.words = words
        self.guess = guess
        self.by_fold: dict[str, list[str]] = {}
        self.by_size: dict[tuple[str, int], list[str]] = {}
        self.by_cut: dict[str, list[str]] = {}
        for w in words:
            self.by_fold.setdefault(folded(w), []).append(w)
            self.by_size.setdefault((w[0], len(w)), []).append(w)
            if len(w) >= slips_from:
                for k in range(len(w)):
                    self.by_cut.setdefault(w[:k] + w[k + 1 :], []).append(w)
        self.slips_from = slips_from
        self.remembered = remembered
        self.longest = max(map(len, words), default=0)
        #: what a word cut in two begins and ends with
        self.openings = {w[:k] for w in words for k in range(1, len(w))}
        self.endings = {w[k:] for w in words for k in range(1, len(w))}
        self._known: dict[str, dict[str, float]] = {}

    def read(self, token: str) -> dict[str, float]:
        got = self._known.get(token)
        if got is None:
            if len(self._known) >= self.remembered:
                self._known.clear()
            got = self._known[token] = self._read(token)
        return got

    def exact(self, word: str) -> bool:
        return word in self.words

    def _read(self, token: str) -> dict[str, float]:
        out: dict[str, float] = {}

        def add(words: Iterable[str], cost: float) -> None:
            for w in words:
                for s in self.words[w]:
                    out[s] = min(out.get(s, 9.0), cost)

        if token in self.words:
            add([token], 0.0)
            return out
        mapped = token.translate(LOOKALIKES)
        word = mapped.strip(SIGNS)
        if not word:
            return out
        if word in self.words:
            add([word], 0.0)
            return out
        if word.isalpha():
            if len(word) > 3 and re.search(r"(.)\1", word):
                add(self.by_fold.get(folded(word), ()), self.LETTERS)
            if not out and len(word) >= self.slips_from - 1:
                self._slips(word, add)
            return out
        letters = sum(c.isalpha() for c in word)
        if not 3 * letters >= len(word) or len(word) > 24:
            if letters == 2 and word[0].isalpha() and word[-1].isalpha() and 6 < len(word) < 16 and set(word[1:-1]) <= set(SIGNS):
                add(self._masked(word), self.SLIP)
            return out
        if not any(c in SIGNS for c in word) and not mapped.endswith(("$", "!")) and not mapped.startswith(("$", "@", "!")):
            # digits for letters
            for one in "il":
                meant = "".join((one if c == "1" else DIGIT_LETTERS[c]) if c in DIGIT_LETTERS else c for c in word)
                add(self.by_fold.get(folded(meant), ()), self.LETTERS)
            return out
        for full in {word, mapped.lstrip("@#"), mapped.rstrip("!"), mapped}:
            if len(full) > 2:
                add(self._masked(full), self.LETTERS)
        return out

    def _masked(self, full: str) -> list[str]:
        first = full[0]
        starts = DIGIT_LETTERS.get(first, first if first.isalpha() else "abcdefghijklmnopqrstuvwxyz")
        if not any(c.isalpha() for c in full[:1] + full[-1:]):
            return []
        pattern = re.compile("".join(f"[{DIGIT_LETTERS[c]}]" if c in DIGIT_LETTERS else "[^\\W\\d_]" if c in SIGNS else re.escape(c) for c in full))
        return [w for s in starts for w in self.by_size.get((s, len(full)), ()) if pattern.fullmatch(w)]

    def _slips(self, word: str, add) -> None:
        found = set(self.by_cut.get(word, ()))
        for k in range(len(word)):
            cut = word[:k] + word[k + 1 :]
            if len(cut) >= self.slips_from and cut in self.words:
                found.add(cut)
            found.update(self.by_cut.get(cut, ()))
        near = [w for w in found if w[0] == word[0] and len(w) >= self.slips_from and _one_slip(word, w)]
        if not any("THING" in self.words[w] for w in near):  # as likely a slip of a harmless word
            add(near, self.SLIP)

    def run_together(self, token: str) -> tuple[str, str] | None:
        """The two words of a token that lacks the blank between them."""
        size, words = len(token), self.words
        for k in range(max(2, size - self.longest), min(size - 1, self.longest + 1)) if size > 5 else ():
            if token[:k] in words and token[k:] in words:
                return token[:k], token[k:]
        return None

    def slipped(self, first: str, second: str) -> list[tuple[str, str]]:
        """The pairs of words that two tokens give when the blank between them moves by one letter."""
        both, words = first + second, self.words
        return [(both[:k], both[k:]) for k in (len(first) - 1, len(first) + 1) if both[:k] in words and both[k:] in words] if len(both) > 5 else []

    def may_open(self, token: str) -> bool:
        """Whether a token can be the first of two that read as one word, or with the blank moved."""
        return token in self.openings or token[:-1] in self.words

    def may_close(self, token: str) -> bool:
        """Whether a token can be the second of two that read as one word, or with the blank moved."""
        return token in self.endings or token[1:] in self.words

    def segmented(self, text: str) -> str:
        """Blanks between the words of scripts without blanks: longest words of the lexicon first, else single letters."""

        def cut(m: re.Match) -> str:
            run, out, k = m[0], [], 0
            while k < len(run):
                size = next((z for z in range(min(self.longest, len(run) - k), 1, -1) if run[k : k + z] in self.words), 1)
                out.append(run[k : k + size])
                k += size
            return f" {' '.join(out)} "

        return _UNSPACED.sub(cut, text)

    def lattice(self, clause: str) -> tuple[int, list[tuple[int, int, dict[str, float]]], set[int], set[int]]:
        """Positions, edges (from, to, symbols with costs), positions before which a pause stands and quoted ones, of a clause in plain text."""
        tokens: list[str] = []
        spelled: list[int] = []
        pauses: set[int] = set()
        glued: set[int] = set()
        quoted: set[int] = set()
        open_quote = False

        def take(a: int, b: int) -> None:
            nonlocal open_quote
            last = a
            for t in _TOKEN.finditer(clause, a, b):
                if _QUOTE.search(clause, last, t.start()):
                    open_quote ^= len(_QUOTE.findall(clause, last, t.start())) % 2 == 1
                if open_quote:
                    quoted.add(len(tokens))
                if t.start() > last and not (" " in clause[last : t.start()] or at + last == 0):
                    glued.add(len(tokens))
                if tokens and t.start() > last and _PAUSE.search(clause, last, t.start() + 1):
                    pauses.add(len(tokens))
                tokens.append(t[0])
                last = t.end()
            if b > last and _PAUSE.search(clause, last, b):
                pauses.add(len(tokens))

        at = 0
        for m in _SPELLED.finditer(clause) if letter_by_letter(_TOKEN.findall(clause)) else ():
            take(at, m.start())
            for part in m[0].split(" ") if re.search(r"[._\-]", m[0]) else [m[0]]:
                spelled.append(len(tokens))
                tokens.append(re.sub(r"[ ._\-]", "", part))
            at = m.end()
        take(at, len(clause))
        edges: list[tuple[int, int, dict[str, float]]] = []
        n = len(tokens)
        words = self.words
        merged: list[tuple[int, set[str], set[str]]] = []
        for i, t in enumerate(tokens):
            if "_" in t.strip("_") and (t not in words):
                inner = t.replace("_", "")
                if inner in words and len(t) >= 2 * len(inner) - 1:
                    edges.append((i, i + 1, self.read(inner)))
                else:
                    edges.append((i, i + 1, {}))  # a name in code
                continue
            symbols = self.read(t)
            if i in spelled and not symbols:
                symbols = next((s for s in (self.read(t[1:]), self.read(t[:-1]), self.read(t[2:])) if s), {})
            edges.append((i, i + 1, symbols or self.guess(t)))
            if not symbols and (two := self.run_together(t)):
                merged.append((i, words[two[0]], words[two[1]]))
            if i + 1 < n:
                joined = t + tokens[i + 1]
                if joined in words and (i + 1 in glued or not (t in words and tokens[i + 1] in words) and (len(t) < 3 or len(tokens[i + 1]) < 3 or not symbols)):
                    edges.append((i, i + 2, {s: self.SLIP for s in words[joined]}))
                elif not (symbols and tokens[i + 1] in words):
                    for first, second in self.slipped(t, tokens[i + 1]):
                        edges.append((i, i + 1, {s: self.SLIP for s in words[first]}))
                        edges.append((i + 1, i + 2, {s: self.SLIP for s in words[second]}))
        if merged:
            # a position more for each: word by word from the last, so that places before stay valid
            for i, first, second in reversed(merged):
                edges = [(a + (a > i), b + (b > i), x) for a, b, x in edges]
                edges += [(i, i + 1, {s: self.SLIP for s in first}), (i + 1, i + 2, dict.fromkeys(second, 0.0))]
                pauses = {p + (p > i) for p in pauses}
                quoted = {q + (q > i) for q in quoted}
                n += 1
        return n, edges, pauses, quoted
