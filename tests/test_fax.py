"""Group 4 data: the tables, round trips, and a page in vertical and pass modes coded here."""

import random

import pytest

from folioflow.pdf import fax, filters
from folioflow.pdf.syntax import Name, PdfError, Stream


def pixels(data, width):
    row = (width + 7) // 8
    return [[data[r + x // 8] >> (7 - x % 8) & 1 for x in range(width)] for r in range(0, len(data), row)]


@pytest.mark.parametrize("table", fax.TABLES)
def test_codes_are_prefix_free(table):
    words = sorted(table)
    assert len(words) == 104 and not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


@pytest.mark.parametrize("width", [1, 8, 31, 100, 1728, 5300])
def test_horizontal_round_trip(width):
    rng = random.Random(width)
    rows = [[int(rng.random() < p) for _ in range(width)] for p in (0, 1, 0.5, 0.02, 0.98)]
    assert pixels(fax.decode_g4(fax.encode_g4(rows), width), width) == rows


def coded(rows):
    """The coder of T.6, from its flow chart."""
    vertical = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
    out, above = "", [0] * len(rows[0])
    for row in rows:
        w, a0, color = len(row), -1, 0

        def change(line, at, colour):
            """The first changing element right of at, whose colour is the other one."""
            x = at + 1
            while x < w and not (line[x] != (line[x - 1] if x else 0) and line[x] != colour):
                x += 1
            return x

        while a0 < w:
            a1 = next((x for x in range(max(a0, 0) + (a0 >= 0), w) if row[x] != color), w) if a0 >= 0 else next((x for x in range(w) if row[x] != color), w)
            b1 = change(above, a0, color)
            b2 = next((x for x in range(b1 + 1, w) if above[x] != above[b1]), w) if b1 < w else w
            if b2 < a1:
                out, a0 = out + "0001", b2
            elif abs(a1 - b1) <= 3:
                out, a0, color = out + vertical[a1 - b1], a1, 1 - color
            else:
                a2 = next((x for x in range(a1 + 1, w) if row[x] == color), w)
                out += "001" + fax._run(a1 - max(a0, 0), color) + fax._run(a2 - a1, 1 - color)
                a0 = a2
        above = row
    out += "000000000001" * 2
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


@pytest.mark.parametrize("seed", range(12))
def test_all_modes(seed):
    rng = random.Random(seed)
    width = rng.choice([5, 16, 64, 200])
    rows, row = [], [0] * width
    for _ in range(20):
        row = list(row)
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(width)
            b, v = min(width, a + rng.randint(1, 30)), rng.randint(0, 1)
            row[a:b] = [v] * (b - a)
        rows.append(row)
    assert pixels(fax.decode_g4(coded(rows), width), width) == rows


def test_as_a_filter():
    rows = [[0, 1] * 5, [1] * 10]
    data = filters.decode(Stream({"Filter": Name("CCF"), "DecodeParms": {"K": -1, "Columns": 10}}, fax.encode_g4(rows)))
    assert pixels(data, 10) == rows
    with pytest.raises(PdfError):
        fax.decode_g4(bytes.fromhex("20"), 100)
