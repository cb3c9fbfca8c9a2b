"""CCITT Group 4 fax data (ITU-T T.6)."""

from __future__ import annotations

from folioflow.pdf.syntax import PdfError

# Run-length codes of ITU-T T.4, for runs 0 to 63, then 64 to 1728 by 64
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
WHITE_64 = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
BLACK_64 = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
#: Runs 1792 to 2560, of both colours.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
MODES = {"1": "V0", "011": "VR1", "000011": "VR2", "0000011": "VR3", "010": "VL1", "000010": "VL2", "0000010": "VL3", "001": "H", "0001": "P"}
WIDTH = 1728


def runs(short: str, long: str) -> dict[str, int]:
    out = {c: k for k, c in enumerate(short.split())} | {c: 64 * (k + 1) for k, c in enumerate(long.split())}
    return out | {c: 1792 + 64 * k for k, c in enumerate(LONG.split())}


TABLES = (runs(WHITE, WHITE_64), runs(BLACK, BLACK_64))


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(format(b, "08b") for b in data), 0

    def code(self, table: dict):
        for n in range(1, 14):
            word = self.bits[self.at : self.at + n]
            if len(word) < n:
                return None
            if word in table:
                self.at += n
                return table[word]
        return None

    def run(self, color: int) -> int | None:
        total = 0
        while True:
            n = self.code(TABLES[color])
            if n is None:
                return None
            total += n
            if n < 64:
                return total


def decode_g4(data: bytes, width: int = WIDTH, rows: int = 0) -> bytes:
    """Rows of packed bits, 1 for black, until the end mark, so many rows, or the end of the data."""
    bits, out, above = _Bits(data), bytearray(), [width]
    while not rows or len(out) < rows * ((width + 7) // 8):
        now: list[int] = []  # places where the colour changes, white first
        a0, color, first = 0, 0, True
        while a0 < width:
            mode = bits.code(MODES)
            if mode is None:
                if not first or a0:
                    raise PdfError("Filter", "a fax row is cut short")
                return bytes(out)
            # the first change above to the other colour, right of a0 (of a row's start: at it too)
            k = color
            while k < len(above) and above[k] <= a0 - first:
                k += 2
            b1 = above[k] if k < len(above) else width
            b2 = above[k + 1] if k + 1 < len(above) else width
            if mode == "P":
                a0 = b2
            elif mode == "H":
                for c in (color, 1 - color):
                    n = bits.run(c)
                    if n is None:
                        raise PdfError("Filter", "no run length")
                    a0 = min(width, a0 + n)
                    now.append(a0)
            else:
                shift = int(mode[2:] or 0) if mode != "V0" else 0
                a0 = min(width, max(0, b1 + (shift if mode[1] == "R" else -shift)))
                now.append(a0)
                color = 1 - color
            first = False
        row, at, dark = bytearray((width + 7) // 8), 0, False
        for edge in [*now, width]:
            if dark:
                for x in range(at, edge):
                    row[x >> 3] |= 0x80 >> (x & 7)
            at, dark = max(at, edge), not dark
        out += row
        above = now
    return bytes(out)


def encode_g4(rows: list[list[int]]) -> bytes:
    """Rows of 0 and 1 (black), in horizontal mode throughout, and the end mark: for round trips."""
    out = ""
    for row in rows:
        changes, last = [], 0
        for x, v in enumerate(row):
            if v != last:
                changes.append(x)
                last = v
        edges = [0, *changes, len(row)]
        lengths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        if len(lengths) % 2:
            lengths.append(0)
        for k in range(0, len(lengths), 2):
            out += "001" + _run(lengths[k], 0) + _run(lengths[k + 1], 1)
    out += "000000000001" * 2
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


def _run(n: int, color: int) -> str:
    words = {v: k for k, v in TABLES[color].items()}
    out = ""
    while n > 2623:
        out += words[2560]
        n -= 2560
    if n >= 64:
        out += words[n // 64 * 64]
    return out + words[n % 64]
