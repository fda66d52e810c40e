"""Text that was decoded with the wrong character encoding (problem 2).

Round-trip repair: a garbled run is encoded again under a candidate legacy encoding
and strictly decoded as the intended one; nested layers are undone one after the
other; a step is accepted only when the cost of the run as text drops.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings under which UTF-8 is commonly misread, likeliest first.
LEGACY = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-15", "cp437", "cp850", "mac-roman", "koi8-r", "cp866", "cp1254", "iso8859-2", "cp852", "cp1253", "cp1257", "iso8859-5", "iso8859-7", "cp1255", "cp1256", "mac-cyrillic")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "koi8-u")
WESTERN = ("cp1252", "latin-1", "iso8859-15", "mac-roman", "cp850", "cp437")
#: Single-byte encodings of other Latin alphabets.
LATIN = ("cp1250", "iso8859-2", "cp1254", "cp1257")
#: Letters beyond ASCII of the languages written in Latin letters (fixed values).
ALPHABETS = tuple(map(frozenset, (
    "ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîșțşţ", "čćđšž", "çğıİi̇öşüâî", "āčēģīķļņšūž", "ąčęėįšųūž", "äõöüšž",
    "àâæçéèêëîïôœùûüÿ", "äöüß", "áéíñóúü", "àáâãçéêíóôõú", "åäöæøé", "àèéìíòóù", "áðéíóúýþæö",
)))
#: Single-byte encodings of other scripts, with the letters that make up about two thirds
#: of ordinary text (fixed values).
SCRIPTS = {
    "cp1253": "αοιετσνηυρ", "iso8859-7": "αοιετσνηυρ", "cp1255": "יוהלאתמרבש", "iso8859-8": "יוהלאתמרבש", "cp1256": "اليـنمتروبعة", "iso8859-6": "اليـنمتروبعة",
}
#: Encodings of two bytes a character, each with the characters it must show to be believed.
EAST_ASIAN = (("cp932", "[\u3040-\u30ff]", 0.2), ("euc_jp", "[\u3040-\u30ff]", 0.2), ("cp949", "[\uac00-\ud7a3]", 0.7), ("gb2312", "[\u4e00-\u9fff]", 0.7), ("big5", "[\u4e00-\u9fff]", 0.7))
LAYERS = 4

_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_REFERENCE = re.compile(r"&(?:#(\d{2,7})|#[xX]([0-9a-fA-F]{2,6})|([A-Za-z][A-Za-z0-9]{1,7}));")
#: What a lossy decoder leaves: a lead character whose continuation was dropped or became a space.
_REST = re.compile("â€(?=[\\s<\"'.,;:!?)a-zA-Z]|$)|(?<![A-ZÀ-Þ])Ã (?=[a-z])|ï»¿|ï¿½")
_RUSSIAN = frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_PLAIN = frozenset("àâäáãåæçéèêëíìîïñóòôöõøœßúùûüÿýÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜÝ" + "".join(_RUSSIAN) + "".join(_RUSSIAN).upper())
_MARKS = frozenset("‘’“”„‚–—…«»€£¥°©®™•·¿¡№§×\xa0→←↑↓ªº±½")
#: Further letters of Ukrainian, read as a Russian one.
_BESIDE = str.maketrans("іїєґІЇЄҐ", "ииииИИИИ")
#: Letters that make up nearly two thirds of ordinary Russian text (fixed values).
_FREQUENT = frozenset("оеаинтсрвл")


def _table(name: str) -> dict[int, str]:
    """Char to byte of a single-byte encoding, undefined bytes read as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_ENCODE = {name: _table(name) for name in dict.fromkeys((*LEGACY, *CYRILLIC, *WESTERN, *LATIN, *SCRIPTS))}
_DECODE = {name: {b: c for c, b in table.items()} for name, table in _ENCODE.items()}


_LATIN_LETTERS = {name: frozenset(c for c in _ENCODE[name] if "\u0100" <= c < "\u0180") for name in LATIN}


def to_bytes(text: str, name: str) -> bytes | None:
    table = _ENCODE[name]
    out = bytearray()
    for c in text:
        if c < "\x80":
            out.append(ord(c))
        elif (b := table.get(c)) is None:
            return None
        else:
            out.append(b)
    return bytes(out)


def char_cost(c: str) -> float:
    if c < "\x80":
        return 0.0
    if c in _PLAIN:
        return 0.3
    if c in _MARKS:
        return 0.6
    category = unicodedata.category(c)
    if category in ("Cc", "Cn", "Co", "Cs") or c == "�":
        return 3.0
    if category[0] in "LM":
        return 0.6 if c < "\u0180" or c in "ơưƠƯ" or "\u1e00" <= c <= "\u1eff" or "\u3040" <= c <= "\ud7a3" else 1.5
    return 1.5


def _one_script(text: str) -> bool:
    return len({unicodedata.name(c, "?").split(" ")[0] for c in text}) == 1


def run_cost(text: str) -> float:
    """What a run of characters beyond ASCII costs as text.

    Russian words in ordinary letter case are cheap; two or more letters of one other
    script cost no more than accented ones.
    """
    if all(c in _RUSSIAN for c in text[1:]) and text[:1].lower() in _RUSSIAN or all(c.lower() in _RUSSIAN and c.isupper() for c in text):
        return 0.1 * len(text)
    if len(text) > 1 and all(unicodedata.category(c)[0] == "L" for c in text) and not any(c in _PLAIN for c in text) and _one_script(text):
        return 0.4 * len(text)
    return sum(map(char_cost, text))


def _script(c: str) -> str:
    if c < "ɐ":
        return "latin"
    if c < "Ѐ":
        return "greek" if c >= "Ͱ" else "other"
    return "cyrillic" if c < "԰" else "other"


@lru_cache(maxsize=200_000)
def word_cost(word: str) -> float:
    """What a word costs as text: strange characters, letters of several scripts, and
    capitals or symbols in the middle of small letters."""
    cost = sum(map(char_cost, word))
    letters = [c for c in word if c.isalpha()]
    if len({_script(c) for c in letters}) > 1:
        cost += 2.0
    for a, b in zip(word, word[1:]):
        if a.islower() and (b.isupper() and b >= "\x80"):
            cost += 1.5
        elif a.isalpha() and b >= "\x80" and not b.isalnum() and b not in "’‘'”“«»–—…­":
            cost += 0.9
    return cost


def _decodings(run: str) -> dict[str, str]:
    """What the run becomes under each legacy encoding that undoes to valid UTF-8."""
    out: dict[str, str] = {}
    for name in LEGACY:
        data = to_bytes(run, name)
        if data is None:
            continue
        try:
            out[name] = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
    return out


@lru_cache(maxsize=200_000)
def repair_run(run: str, likely: str = "", depth: int = LAYERS) -> tuple[str, int, str]:
    """``(text, layers, encoding)`` of a run of characters beyond ASCII that hides UTF-8.

    Layers are undone as long as what comes out in the end costs less. Zero layers: it
    hides none. ``encoding`` is the outermost one undone; ``likely`` is taken where
    several do equally well.
    """
    best, found = run_cost(run), (run, 0, "")
    if depth == 0 or len(run) < 2:
        return found
    for name, text in _decodings(run).items():
        inner, layers, _ = repair_run(text, likely, depth - 1)
        cost = run_cost(inner) - 0.01 * (name == likely)
        if cost < best and run_cost(inner) < run_cost(run):
            best, found = cost, (inner, layers + 1, name)
    return found


@lru_cache(maxsize=200_000)
def _broken_inside(run: str) -> tuple[str, int]:
    """As ``repair_run`` for the sequences within a run that is not garbled as a whole."""
    if run_cost(run) <= 0.1 * len(run):
        return run, 0
    out, done, k = [], 0, 0
    while k < len(run):
        for size in range(min(9, len(run) - k), 1, -1):
            got, layers, _ = repair_run(run[k : k + size])
            if layers and len(got) * 2 <= size + 1 and all(c in _PLAIN or c in _MARKS for c in got):
                out.append(got)
                done += 1
                k += size
                break
        else:
            out.append(run[k])
            k += 1
    return "".join(out), done


def likely_encoding(text: str) -> str:
    """The legacy encoding whose removal leaves the garbled words of a text at the least cost."""
    words = [w for w in dict.fromkeys(_WORD.findall(text)) if any(len(r) > 1 and repair_run(r)[1] for r in _RUN.findall(w))]
    best, found = None, ""
    for name in LEGACY if words else ():
        undone, cost = 0, 0.0
        for w in words:
            whole = True

            def one(m: re.Match[str]) -> str:
                nonlocal whole
                data = to_bytes(m[0], name)
                try:
                    return data.decode("utf-8") if data is not None else m[0]
                except UnicodeDecodeError:
                    whole = False
                    return m[0]

            now = _RUN.sub(one, w)
            undone += whole and now != w
            cost += word_cost(now)
        if best is None or (-undone, cost) < best:
            best, found = (-undone, cost), name
    return found


def _recode(text: str, wrong: str, right: str) -> str | None:
    data = to_bytes(text, wrong)
    if data is None:
        return None
    table = _DECODE[right]
    return "".join(table.get(b, chr(b)) if b > 127 else chr(b) for b in data)


def _odd_runs(text: str) -> list[str]:
    """Distinct runs of three characters or more that are no Russian word in ordinary case."""
    return [w for w in dict.fromkeys(_RUN.findall(text)) if len(w) >= 3 and run_cost(w) > 0.15 * len(w) and not _one_foreign_script(w)]


def _one_foreign_script(run: str) -> bool:
    return all("\u0900" <= c <= "\ud7a3" or "\uff00" <= c <= "\uffef" or "\u0590" <= c <= "\u06ff" for c in run)


def cyrillic_pair(runs: list[str]) -> tuple[str, str] | None:
    """``(wrong, right)`` single-byte encodings if the runs are Russian words misread.

    Under the right pair nearly all runs become Russian words in ordinary case, made of
    frequent letters, and their cost drops; two different runs are the least evidence.
    """
    if len(runs) < 2:
        return None
    best, pair = 0.0, None
    for wrong in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "iso8859-5", "cp1250"):
        for right in CYRILLIC:
            if wrong == right:
                continue
            gain = good = size = hits = 0.0
            for w in runs:
                text = _recode(w, wrong, right)
                if text is None:
                    continue
                text = text.translate(_BESIDE)
                letters = [c for c in text.lower() if c.isalpha()]
                if len(letters) < max(3, len(text)) or not all(c in _RUSSIAN for c in letters) or run_cost("".join(c for c in text if c.isalpha())) > 0.1 * len(letters) + 1e-9:
                    gain -= 1.0
                    continue
                hits += 1
                size += len(letters)
                good += sum(c in _FREQUENT for c in letters)
                gain += run_cost(w) - run_cost(text)
            if hits >= 2 and hits >= 0.7 * len(runs) and good >= 0.45 * size and gain > best:
                best, pair = gain, (wrong, right)
    return pair


_SOUP = re.compile(r"[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{3,}")


def script_pair(runs: list[str]) -> tuple[str, str] | None:
    """``(wrong, right)`` if runs of accented letters are words of another script, misread one
    byte for one: nearly all become words in ordinary case, of one script and its frequent letters."""
    soup = [w for w in runs if _SOUP.fullmatch(w)]
    if len(soup) < 2:
        return None
    best, pair = 0.0, None
    for wrong in WESTERN[:4]:
        for right, frequent in SCRIPTS.items():
            size = good = hits = 0
            for w in soup:
                text = _recode(w, wrong, right)
                letters = [c for c in text or "" if c.isalpha()]
                if len(letters) < max(3, len(w) - 1) or {_script_name(c) for c in letters} != {_script_name(frequent[0])} or not (text[1:] == text[1:].lower() or text == text.upper()):
                    continue
                hits += 1
                size += len(letters)
                good += sum(unicodedata.normalize("NFD", c.lower())[0].replace("ς", "σ") in frequent for c in letters)
            if hits >= 2 and hits >= 0.7 * len(soup) and good >= 0.5 * size and good * hits / len(soup) > best:
                best, pair = good * hits / len(soup), (wrong, right)
    return pair


def _script_name(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def east_asian(text: str) -> tuple[str, str] | None:
    """``(text, encoding)`` with the segments that hide an encoding of two bytes a character
    decoded: strictly, into six characters or more of what the encoding is known by."""
    found: dict[str, list[tuple[str, str]]] = {}
    for segment in dict.fromkeys(_SEGMENT.findall(text)):
        beyond = sum(c >= "\x80" for c in segment)
        if beyond < 4 or beyond < 0.3 * len(segment) or not _SOUP.search(segment):
            continue
        for wrong in ("latin-1", "cp1252"):
            data = to_bytes(segment, wrong)
            for right, known, share in EAST_ASIAN if data else ():
                try:
                    plain = data.decode(right)
                except UnicodeDecodeError:
                    continue
                wide = [c for c in plain if c >= "\x80"]
                if all("\u2010" <= c <= "\u2027" or "\u3000" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or "\uff00" <= c <= "\uff60" for c in wide) and len(re.findall(known, plain)) >= share * len(wide):
                    found.setdefault(right, []).append((segment, plain))
    best = max(found.items(), key=lambda x: len({s for s, _ in x[1]}), default=None)
    if not best or sum(c >= "\x80" for _, plain in dict(best[1]).items() for c in plain) < 6:
        return None
    plains = dict(best[1])
    return _SEGMENT.sub(lambda m: plains.get(m[0], m[0]), text), best[0]


def _one_alphabet(letters: set[str]) -> bool:
    return any(letters <= a for a in ALPHABETS)


def latin_pair(words: list[str]) -> tuple[str, str] | None:
    """``(wrong, right)`` if words hold letters and signs that no language writes together, and
    under the pair all of them have the letters of one alphabet, in ordinary case."""
    odd = [w for w in dict.fromkeys(words) if all(len(r) < 3 for r in _RUN.findall(w))]
    if len(odd) < 3 or _one_alphabet({c for w in odd for c in w.lower() if c >= "\x80" and c not in "’‘“”„«»–—…"}):
        return None
    best, pair = 0, None
    for wrong in ("latin-1", "cp1252", "iso8859-15"):
        for right in LATIN:
            now = [_recode(w, wrong, right) for w in odd]
            if any(t is None for t in now):
                continue
            bare = [t.strip("’‘“”„«»–—…") for t in now]
            letters = {c for t in bare for c in t.lower() if c >= "\x80"}
            changed = sum(t != w for t, w in zip(now, odd))
            if changed > max(best, 2) and len(letters) > 2 and _one_alphabet(letters) and all(t[1:] == t[1:].lower() or t == t.upper() for t in bare):
                best, pair = changed, (wrong, right)
    return pair


def western_pair(words: list[str]) -> tuple[str, str] | None:
    """``(wrong, right)`` if words of Latin letters had their accents misread one byte for one."""
    # accents stand alone or in twos; longer runs are words of another script that were glued on
    odd = [w for w in dict.fromkeys(words) if len(w) >= 4 and word_cost(w) >= 1.4 and all(len(r) < 3 for r in _RUN.findall(w))]
    if len(odd) < 2:
        return None
    best, pair = 0.0, None
    for wrong in (*WESTERN, "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-5", "iso8859-7"):
        for right in (*WESTERN, *LATIN):
            if wrong == right:
                continue
            gain = hits = 0.0
            other = "" if right in WESTERN else _LATIN_LETTERS[right]
            for w in odd:
                text = _recode(w, wrong, right)
                if text is not None and all(c < "\x80" or c in _PLAIN or c in "’‘" or c in other for c in text) and (drop := word_cost(w) - word_cost(text)) >= 1.0:
                    hits += 1
                    gain += drop
            if hits >= 2 and hits >= 0.7 * len(odd) and gain > best:
                best, pair = gain, (wrong, right)
    return pair


def decode_references(source: str) -> str:
    """Character references beyond ASCII as characters."""

    def one(m: re.Match[str]) -> str:
        if m[3]:
            c = html5.get(m[3] + ";", "")
            return c if len(c) == 1 and c >= "\x80" else m[0]
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if 128 <= n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _REFERENCE.sub(one, source)


_UNIT = re.compile(r"(?:[^\x00-\x7f]|&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,7});)+")
#: A character reference that is no plain markup escape.
_REFERENCE_BEYOND = re.compile(r"&(?:#(?!(?:3[489]|39|60|62);)|(?!(?:amp|lt|gt|quot|apos|nbsp);)[A-Za-z])")


@lru_cache(maxsize=200_000)
def _odd_run(run: str) -> bool:
    """Whether a run gives cause to look closer: a necessary condition of every repair."""
    if "�" in run or any(char_cost(c) >= 1.5 for c in run) or _script(run[0]) != _script(run[-1]):
        return True
    return len(run) > 1 and (run_cost(run) > 0.15 * len(run) and len(run) > 2 or repair_run(run)[1] > 0 or _broken_inside(run)[1] > 0)


def _suspicious(source: str) -> bool:
    text = decode_references(source) if "&" in source and _REFERENCE_BEYOND.search(source) else source
    runs = set(_RUN.findall(text))
    if any(map(_odd_run, runs)):
        return True
    if ("â" in runs or "Ã" in runs or "ï" in text) and _REST.search(text):
        return True
    if ("ð" in runs or "þ" in runs) and ("ç" in runs or "ü" in runs):
        return True
    # one accent for another inside a word: a capital, a mark or another script after a small letter
    return any((not r[0].islower() or _script(r[0]) != "latin") and _INSIDE.search(text) for r in runs if len(r) == 1 and r not in "’\xa0")


_INSIDE = re.compile(r"[a-z][¡-©«¬®-¶¸¹»-¿][a-z]|[a-z](?:[À-ÞЀ-ӿͰ-Ͽ]|[^\x00-\xbf’‘“”«»–—…·•\s](?<![a-zß-ÿœšž]))[a-z]?")
_SEGMENT = re.compile(r"[^<>\"]*[^\x00-\x7f][^<>\"]*")
_LATIN_WORD = re.compile(r"(?=[^\x00-\x7f]*[A-Za-z])[A-Za-z\x80-\U0010ffff]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")


def restore(source: str) -> tuple[str, int, str, bool] | None:
    """``(text, layers, encoding, whole)`` of a garbled text, None for one that is not.

    Only the garbled places are rewritten, character references among them as plain
    characters. ``whole`` tells that nothing known to be lost remains; where the bytes
    did not survive (replacement characters) the text stays as it is.
    """
    if source.isascii() and ("&" not in source or not _REFERENCE_BEYOND.search(source)):
        return None
    if not _suspicious(source):
        return None
    layers, encoding = 0, ""
    inside = undone = False
    likely = ""

    def fix(m: re.Match[str]) -> str:
        nonlocal undone, encoding
        run = m[0]
        if "&" in run:
            run = decode_references(run)
            if run.isascii() or "&" in run:
                return m[0]
        if len(run) < 2:
            return m[0]
        _, n, name = repair_run(run, likely)
        text = to_bytes(run, name).decode("utf-8") if n else run
        if not n and likely and (data := to_bytes(run, likely)):
            try:
                plain = data.decode("utf-8")
            except UnicodeDecodeError:
                plain = ""
            if plain and all(c in _PLAIN or c in _MARKS or len(plain) == 1 and likely in (*WESTERN[:3], "cp1251") and ("Ά" <= c <= "ώ" or "Ѐ" <= c <= "џ") for c in plain):
                text, n, name = plain, 1, likely
        if not n and inside and len(run) > 2:
            text, n = _broken_inside(run)
            name = "mixed"
        if not n:
            return m[0]
        undone = True
        encoding = encoding or name
        return text

    def undo_cyrillic(text: str) -> str:
        nonlocal layers, encoding
        odd = _odd_runs(text)
        if not odd:
            return text
        names = set(odd)
        # capitals beside an odd word are evidence too: one such encoding swaps the letter cases
        beside = [runs for runs in map(_RUN.findall, _SEGMENT.findall(text)) if not names.isdisjoint(runs)]
        near = [r for runs in beside for r in runs if len(r) > 2 and r.isupper()]
        pair = cyrillic_pair(list(dict.fromkeys([*odd, *near])))
        if not pair:
            return text

        def sound(run: str) -> bool:
            return len(run) > 2 and run not in names and not run.isupper()

        def recode(m: re.Match[str]) -> str:
            runs = _RUN.findall(m[0])
            if any(map(sound, runs)):
                return m[0]
            if not any(r in names for r in runs):
                # capitals only: recode where that makes ordinary words of more frequent letters
                now = [_recode(r, *pair) or "" for r in runs]
                common = lambda ws: sum(c in _FREQUENT for w in ws for c in w.lower())
                if not all(w and run_cost(w) <= 0.1 * len(w) + 1e-9 for w, r in zip(now, runs) if r.isalpha()) or common(now) <= common(runs):
                    return m[0]
            return _RUN.sub(lambda r: _recode(r[0], *pair) or r[0], m[0])

        layers, encoding = layers + 1, encoding or pair[0]
        return _SEGMENT.sub(recode, text)

    text = undo_cyrillic(source)
    for _ in range(LAYERS):
        # one layer at a time: which encoding the next one was read in shows only then
        undone = False
        likely = likely_encoding(decode_references(text) if "&" in text else text)
        text = _UNIT.sub(fix, text)
        if not undone:
            break
        layers += 1
    if _REST.search(text):
        text = text.replace("ï»¿", "").replace("ï¿½", "�")
        text = re.sub(r"(?<![A-ZÀ-Þ])Ã (?=[a-z])", "à ", text)
        text = re.sub("â€(?=[\\s<\"'.,;:!?)a-zA-Z]|$)", "”", text)
        layers, encoding = max(layers, 1), encoding or "cp1252"
    if layers:
        text = undo_cyrillic(text)
    elif _SOUP.search(text):
        if wide := east_asian(text):
            text, encoding = wide
            layers = 1
        elif pair := script_pair(list(dict.fromkeys(_RUN.findall(text)))):
            text = _SEGMENT.sub(lambda m: _RUN.sub(lambda r: _recode(r[0], *pair) or r[0], m[0]) if _SOUP.search(m[0]) else m[0], text)
            layers, encoding = 1, f"{pair[0]}>{pair[1]}"
    inside, undone = True, False
    text = _UNIT.sub(fix, text)
    layers += undone
    words = _LATIN_WORD.findall(text)
    if words and not layers and (pair := latin_pair(words)):
        text = _LATIN_WORD.sub(lambda m: _recode(m[0], *pair) or m[0], text)
        layers, encoding = 1, f"{pair[0]}>{pair[1]}"
    elif words and (pair := western_pair(words)):
        text = _LATIN_WORD.sub(lambda m: (_recode(m[0], *pair) or m[0]) if word_cost(m[0]) >= 1.4 else m[0], text)
        layers, encoding = layers + 1, encoding or f"{pair[0]}>{pair[1]}"
    lost = "�" in text or bool(re.search(r"&#(?:65533|[xX][fF]{3}[dD]);", source))
    return (text, layers, encoding, not lost) if layers or lost else None


_SCHEMA = "id bigint, layers int, encoding string, whole boolean, restored string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and (got := restore(text)):
                rows.append((id_, got[1], got[2] or None, got[3], got[0]))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "layers", "encoding", "whole", "restored"])


def garbled(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, layers, encoding, whole, restored`` of every text that came out of a wrong decoding.

    ``layers`` 0 means that nothing could be restored. Null and empty texts are not
    garbled; repeated rows are reported each; other columns are not read. One scan,
    no shuffle.
    """
    return df.select(F.col(id_col).cast("bigint"), F.col(text).cast("string")).mapInArrow(_repair, _SCHEMA)

