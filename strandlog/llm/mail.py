"""The writer's own plain text of a raw mail, as blocks of lines with their places in the text."""

from __future__ import annotations

import re

LINE = re.compile(r"[^\n]*\n?")
HEADER_END = re.compile(r"\r?\n[ \t]*\r?\n")
TYPE = re.compile(r"(?im)^content-type:[ \t]*([^;\s]+)((?:[^\n]|\n[ \t])*)")
ENCODING = re.compile(r"(?im)^content-transfer-encoding:[ \t]*(\S+)")
BOUNDARY = re.compile(r'(?i)boundary[ \t]*=[ \t]*(?:"([^"\n]+)"|([^\s;]+))')
DISPOSITION = re.compile(r"(?im)^content-disposition:[ \t]*attachment")
#: Encodings whose bodies hold no plain text.
ENCODED = ("base64", "quoted-printable")

FORWARD = re.compile(r"\s*-{2,}[ \t]*[^\W\d_][^\n]*?-{2,}\s*|\s*(?:begin forwarded message|original message|forwarded message)\s*:?\s*", re.I)
HEAD_LINE = re.compile(r"\s*(?:From|Von|De|От|Da)[ \xa0]?: ?\S")
SENT_LINE = re.compile(r"\s*(?:Sent|Date|To|Gesendet|Envoyé|Enviado|Отправлено)[ \xa0]?: ?\S")
SIGNATURE = re.compile(r"--[ \t]?\r?\n?")
UU_BEGIN = re.compile(r"begin [0-7]{3,4} \S")
UU_END = re.compile(r"end\s*")
CODED = re.compile(r"[A-Za-z0-9+/]{56,}={0,2}\s*")
COLONS = (":", "：")

Line = tuple[int, int]

# Wrongly decoded UTF-8: characters that stand for the bytes 0x80 to 0xff.
_BYTE = {}
for _b in range(0x80, 0x100):
    _BYTE[chr(_b)] = _b
    try:
        _BYTE[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        pass
_TAIL = "".join(re.escape(c) for c, b in _BYTE.items() if b < 0xC0)
WRONG = re.compile("[Â-ß][%s]|[à-ï][%s]{2}|[ð-ô][%s]{3}" % (_TAIL, _TAIL, _TAIL))


def mended(text: str) -> tuple[str, list[int] | None]:
    """The text as it was meant, and for each of its characters where it ends in the given one (None: the same)."""
    if not WRONG.search(text):
        return text, None
    out, ends, at = [], [], 0
    for m in WRONG.finditer(text):
        try:
            c = bytes(_BYTE[x] for x in m[0]).decode()
        except UnicodeDecodeError:
            continue
        out.append(text[at : m.start()])
        ends.extend(range(at + 1, m.start() + 1))
        out.append(c)
        ends.append(m.end())
        at = m.end()
    out.append(text[at:])
    ends.extend(range(at + 1, len(text) + 1))
    return "".join(out), ends


def _lines(text: str, start: int, end: int) -> list[Line]:
    out, at = [], start
    while at < end:
        nl = text.find("\n", at, end)
        stop = end if nl < 0 else nl + 1
        out.append((at, stop))
        at = stop
    return out


def body_spans(text: str) -> list[Line]:
    """Where plain bodies lie: the body, or of a multipart mail its first text/plain part."""
    head = HEADER_END.search(text)
    if not head:
        return []
    top = text[: head.start()]
    kind = TYPE.search(top)
    if not (kind and kind[1].lower().startswith("multipart/")):
        encoding = ENCODING.search(top)
        plain = not kind or kind[1].lower() == "text/plain"
        return [(head.end(), len(text))] if plain and not (encoding and encoding[1].lower() in ENCODED) else []
    mark = BOUNDARY.search(kind[2])
    if not mark:
        return []
    mark = "--" + (mark[1] or mark[2])
    places = [m.start() for m in re.finditer(r"^" + re.escape(mark), text[head.end() :], re.M)]
    places = [p + head.end() for p in places]
    for a, z in zip(places, [*places[1:], len(text)]):
        first = text.find("\n", a, z)
        if first < 0 or text.startswith(mark + "--", a):
            continue
        inner = HEADER_END.search(text, first, z)
        start = inner.end() if inner else z
        fields = text[first:start]
        if text[first + 1 : first + 3].strip(" \t\r") == "" and "\n" in text[first + 1 : first + 3]:
            start, fields = text.find("\n", first + 1) + 1, ""  # a part without fields
        kind = TYPE.search(fields)
        if (kind and kind[1].lower() != "text/plain") or DISPOSITION.search(fields):
            continue
        encoding = ENCODING.search(fields)
        return [] if encoding and encoding[1].lower() in ENCODED else [(start, z)]
    return []


def introduces(text: str, block: list[Line]) -> bool:
    """Whether a paragraph ends in a colon, also one that was decoded wrongly."""
    return mended(text[block[0][0] : block[-1][1]].rstrip()[-12:])[0].endswith(COLONS)


def own_blocks(text: str) -> list[list[Line]]:
    """Blocks of consecutive lines (start, end) that the writer wrote, parted by empty lines and by what is left out."""
    blocks: list[list[Line]] = []
    for start, end in body_spans(text):
        lines = _lines(text, start, end)
        block: list[Line] = []
        quoted = False
        i, n = 0, len(lines)
        while i < n:
            a, z = lines[i]
            line = text[a:z]
            bare = line.strip()
            if not bare:
                if block:
                    blocks.append(block)
                    block = []
                quoted = False
            elif line[0] == ">":
                if not quoted:  # the paragraph directly above introduces the quotation
                    if block and introduces(text, block):
                        block = []
                    elif not block and blocks and introduces(text, blocks[-1]) and "@" in text[blocks[-1][0][0] : blocks[-1][-1][1]]:
                        blocks.pop()
                if block:
                    blocks.append(block)
                    block = []
                quoted = True
            elif bare == "--" and SIGNATURE.fullmatch(line):
                break
            elif bare[0] == "-" and FORWARD.fullmatch(line) or bare[0] in "bBoOfF" and FORWARD.fullmatch(line):
                break
            elif i + 2 < n and bare.endswith(COLONS) and HEAD_LINE.match(text[slice(*lines[i + 1])]) and SENT_LINE.match(text[slice(*lines[i + 2])]):
                break
            elif UU_BEGIN.match(line):
                if block:
                    blocks.append(block)
                    block = []
                i += 1
                while i < n and not UU_END.fullmatch(text[slice(*lines[i])]):
                    i += 1
            elif len(bare) >= 56 and CODED.fullmatch(line) and i + 1 < n and CODED.fullmatch(text[slice(*lines[i + 1])]):
                if block:
                    blocks.append(block)
                    block = []
                while i + 1 < n and text[slice(*lines[i + 1])].strip() and " " not in text[slice(*lines[i + 1])].strip():
                    i += 1
            else:
                block.append((a, z))
                quoted = False
            i += 1
        if block:
            blocks.append(block)
    return blocks
