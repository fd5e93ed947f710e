"""What headers and end marks say of images, as Spark SQL over their bytes: nothing is decoded."""

from __future__ import annotations

from sievework.functions.tables import IMAGE_PIXELS, IMAGE_SIDE

_number = lambda content, at, n: f"cast(conv(hex(substring({content}, {at}, {n})), 16, 10) as bigint)"


def riff_end(content: str) -> str:
    """Where a RIFF header says that the file ends, from bytes 4 to 7, the least first; null where that is below 12 or beyond the content."""
    stated = "8 + " + " + ".join(f"{256**k} * {_number(content, 5 + k, 1)}" for k in range(4))
    return f"CASE WHEN {stated} BETWEEN 12 AND octet_length({content}) THEN {stated} END"


def image_end(content: str, kind: str) -> str:
    """Where an image of this kind (SQL: jpeg, png, webp) ends: after the last FF D9, after the last IEND with its check sum or at the content's end if that is cut, or where RIFF says; null if there is no such mark."""
    t = f"decode({content}, 'ISO-8859-1')"
    after = lambda reversed_mark: f"length({t}) - instr(reverse({t}), decode(X'{reversed_mark}', 'ISO-8859-1')) + 1"
    has = lambda mark: f"instr({t}, decode(X'{mark}', 'ISO-8859-1')) > 0"
    return f"CASE WHEN {kind} = 'jpeg' AND {has('FFD9')} THEN cast({after('D9FF')} as bigint) WHEN {kind} = 'png' AND {has('49454E44')} THEN cast(least(length({t}), {after('444E4549')} + 4) as bigint) WHEN {kind} = 'webp' THEN {riff_end(content)} END"


def png_size(content: str) -> tuple[str, str]:
    """Width and height of a PNG from its first chunk; null if it is shorter."""
    return tuple(f"CASE WHEN startswith({content}, X'89504E470D0A1A0A') AND octet_length({content}) >= 24 THEN {_number(content, at, 4)} END" for at in (17, 21))


def refused_size(width: str, height: str) -> str:
    """Whether an image is empty or larger than what is decoded."""
    return f"({width} = 0 OR {height} = 0 OR greatest({width}, {height}) > {IMAGE_SIDE} OR {width} * {height} > {IMAGE_PIXELS})"
