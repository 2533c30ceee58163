"""Names of entries: which code page an archive's raw names are in, and their text."""

from __future__ import annotations

from dataclasses import dataclass

# The code pages looked at, in order of preference, with their Python codecs.
CODEPAGES = {"Cp949": "cp949", "ShiftJis": "shift_jis", "Gbk": "gbk", "Big5": "big5"}
LOCALES = {"ko": "Cp949", "ja": "ShiftJis", "zh": "Gbk", "zh_TW": "Big5", "zh_HK": "Big5", "zh_MO": "Big5"}


@dataclass
class RawName:
    raw: bytes
    utf8_flag: bool = False
    unicode_path: str | None = None


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _points(codepage: str, text: str) -> int:
    """Characters that speak for a code page: four for its own script, one for Han, none for half-width kana."""
    total = 0
    for c in text:
        if codepage == "Cp949" and ("가" <= c <= "힣" or "㄰" <= c <= "㆏" or "ᄀ" <= c <= "ᇿ"):
            total += 4
        elif codepage == "ShiftJis" and "぀" <= c <= "ヿ":
            total += 4
        elif "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿":
            total += 1
    return total


def _common(codepage: str, raw: bytes) -> tuple[int, int]:
    """How many of a name's characters beyond ASCII lie in the rows of a code page that everyday text is written in, and how many there are."""
    common = total = at = 0
    while at < len(raw):
        lead = raw[at]
        at += 1
        if lead < 0x80:
            continue
        total += 1
        if codepage == "ShiftJis" and 0xA1 <= lead <= 0xDF:  # half-width kana stand alone
            continue
        code = lead << 8 | (raw[at] if at < len(raw) else 0)
        at += 1
        low, high = code >> 8, code & 0xFF
        common += {
            "Cp949": 0xB0 <= low <= 0xC8 and high >= 0xA1,
            "ShiftJis": 0x829F <= code <= 0x82F1 or 0x8340 <= code <= 0x8396 or 0x889F <= code <= 0x9872,
            "Gbk": 0xB0 <= low <= 0xD7 and high >= 0xA1,
            "Big5": 0xA440 <= code <= 0xC67E,
        }[codepage]
    return common, total


def detect_codepage(names: list[RawName], override: str | None = None, locale: str | None = None) -> str:
    """``Utf8`` or a code page for the names that are no UTF-8, by the content of all of them.

    A code page that cannot decode a name is out. Of the others the one wins in which most characters are common
    ones; where several tie, the one with the most characters of its own script, then the earlier one. If in none
    half of the characters are common, the code page of ``locale`` (as ``ko_KR``) is taken, or without one the script
    alone decides; names without any such character stay UTF-8.
    """
    if override:
        return override
    odd = [n.raw for n in names if n.unicode_path is None and _utf8(n.raw) is None]
    if all(n.utf8_flag for n in names if n.unicode_path is None and _utf8(n.raw) is None):
        return "Utf8"
    found = []
    for place, (codepage, codec) in enumerate(CODEPAGES.items()):
        try:
            points = sum(_points(codepage, raw.decode(codec)) for raw in odd)
        except UnicodeDecodeError:
            continue
        counts = [_common(codepage, raw) for raw in odd]
        share = sum(c for c, _ in counts) / max(1, sum(n for _, n in counts))
        found.append((share if share >= 0.5 else 0.0, points, -place, codepage))
    found = [f for f in found if f[1]]
    if not any(f[0] for f in found) and locale and (page := LOCALES.get(locale.split(".")[0], LOCALES.get(locale[:2]))):
        return page
    return max(found)[3] if found else "Utf8"


def decode_name(name: RawName, codepage: str) -> str:
    """The Unicode path if there is one; else UTF-8 if it is valid; else the archive's code page, or replacement characters."""
    if name.unicode_path is not None:
        return name.unicode_path
    text = _utf8(name.raw)
    return text if text is not None else name.raw.decode(CODEPAGES.get(codepage, "utf-8"), "replace")


def decode_names(names: list[RawName], override: str | None = None) -> tuple[list[str], str]:
    codepage = detect_codepage(names, override)
    return [decode_name(n, codepage) for n in names], codepage
