import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cartolith.llm import conversation_repair as C

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Plain search: rows are (initial, fault); the least (cost, audit) over all edits, row by row."""
    state = {0: (0, "")}
    for initial, fault in [*rows, (None, None)]:
        grown = dict(state)
        for _ in range(3):  # insertions before the row
            for p, (cost, audit) in list(grown.items()):
                for x in "ua":
                    if (p, x) in STEPS:
                        q, new = STEPS[p, x], (cost + 3, audit + "I")
                        if q not in grown or new < grown[q]:
                            grown[q] = new
        if initial is None:
            return min(grown[q] for q in (0, 3) if q in grown)
        state = {}
        for p, (cost, audit) in grown.items():
            options = [(p, cost + 4, audit + "D")]
            if fault not in ("b", "d"):
                extra = 3 if fault == "t" else 0
                options += [(STEPS[p, initial], cost + extra, audit + "K")] if (p, initial) in STEPS else []
                options += [(STEPS[p, x], cost + 3 + extra, audit + "R") for x in "ua" if (p, x) in STEPS]
            for q, c, a in options:
                if q not in state or (c, a) < state[q]:
                    state[q] = (c, a)


def chart(rows):
    """All splits of all spans, the textbook chart."""
    n = len(rows)
    cells = {(i, i + 1): C.short_span(rows[i]) for i in range(n)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            cell = {}
            for k in range(i + 1, i + width):
                for at, found in C.joined(cells[i, k], cells[k, i + width]).items():
                    C.least(cell, at, found)
            cells[i, i + width] = cell
    return cells[0, n]


def spelled(rows):
    return [(x.lower(), "b" if x == "x" else "t" if x.isupper() else "-") for x in rows]


def test_one_split_a_span_equals_the_chart_of_all_splits():
    rng = random.Random(1)
    for n in range(1, 12):
        for _ in range(12):
            rows = "".join(rng.choice("suaoSUAOx") for _ in range(n))
            assert C.span_cell(rows) == chart(rows), rows


def test_cells_equal_a_plain_search():
    for n in range(0, 4):
        for rows in itertools.product("suaoUAx", repeat=n):
            assert C.repair("".join(rows)) == cheapest(spelled(rows)), rows
    rng = random.Random(2)
    for _ in range(150):
        rows = "".join(rng.choice("suaUAx") for _ in range(rng.randrange(5, 60)))
        assert C.repair(rows) == cheapest(spelled(rows)), rows
    assert C.repair("usaua") == cheapest(spelled("usaua")) and C.repair("sua") == (0, "KKK") and C.repair("su") == (3, "KKI")
    assert C.repair("s") == (4, "D") and C.repair("") == (0, "")


def want(rows):
    """The contract, row by row. rows: conv_id, turn, role, text."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        was = (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        convs[conv] += [(was, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, held in convs.items():
        held.sort(key=lambda r: r[0])
        faults, seen = [], set()
        for _, _, role, text in held:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not core else "d" if (role, text) in seen else "-" if core[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[2][:1] for r in held]
        turns = {r[1] for r in held} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        lines, at, odd = [], 0, (len(audit) - audit.count("D")) % 2
        for edit in audit:
            name = ("user", "assistant")[(len(lines) - odd) % 2]
            if edit == "I":
                lines.append(f"{name}:")
                continue
            if edit != "D":
                lines.append(f"{held[at][2] if edit == 'K' else name}:{held[at][3]}")
            at += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, digest)
    return out


def save(folder, rows):
    table = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}
    for name in ("cost", "audit", "number", "chunk", "part", "copies", "by_role", "many", "part__", "n__"):
        table[name] = pa.array(["x"] * len(rows), pa.string())
    pq.write_table(pa.table(table), f"{folder}/conversations.parquet")
    return str(folder)


def got(spark, folder):
    rows = C.op11_interval_parsing_repair(spark, folder).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_op11_equals_the_contract_on_the_table(spark, sf):
    t = pq.read_table(f"{sf}/conversations.parquet")
    rows = list(zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True))
    assert got(spark, sf) == want(rows)


EDGES = [
    (1, None, "system", "No turn."), (1, None, "user", "Hi."), (1, 0, "assistant", "Yes!"), (1, 5, None, None), (1, 5, "", "x\x85"), (1, 7, "tool", "42?"),
    (None, 0, "user", "null id."), (None, 1, "assistant", None), (None, None, None, None),
    (2, 3, "user", "  \t\x0b "), (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 2, "user", "same."), (3, 2, "assistant", "same."), (4, 1, "undo", "Kept as u. "),
    (5, 1, "user", "long. " * 20000), (6, -4, "assistant", "né 😀."), (6, 9, "user", "a\nb.\n"),
] + [(7, i // 3, ("user", "assistant", "system")[i * 7 % 3], f"t{i % 11}" + ".?"[i % 2]) for i in range(700)] + [(8, 2, "user", "again.")] * 40


def test_op11_edges(spark, tmp_path, monkeypatch):
    assert got(spark, save(tmp_path, EDGES)) == want(EDGES)
    # several rounds of cells
    monkeypatch.setattr(C, "CHUNK", 5)
    monkeypatch.setattr(C, "FAN", 3)
    assert got(spark, str(tmp_path)) == want(EDGES)


def test_op11_drops_all_rows_of_a_conversation(spark, tmp_path):
    conv = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = got(spark, save(tmp_path, [(conv, 0, "user", "gone.")]))
    assert out == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_op11_empty_table(spark, tmp_path):
    assert got(spark, save(tmp_path, [])) == {}


def test_repaired_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Hm."), (1, 3, "assistant", "Ok."), (2, 1, "system", "S."), (2, 2, "user", "?")], "conv_id long, turn long, role string, text string")
    rows = C.undamaged(rows)
    lines = sorted(tuple(r) for r in C.repaired(rows, C.parsed(rows)).collect())
    assert lines == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Hm."), (1, 3, "K", "assistant", "Ok."), (2, 0, "K", "system", "S."), (2, 1, "K", "user", "?"), (2, 2, "I", "assistant", "")]


@pytest.fixture(autouse=True)
def _restore():
    yield
    C.CHUNK, C.FAN = 256, 64
