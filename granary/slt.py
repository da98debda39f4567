"""Runner for SQL logic tests: ``statement ok``, ``statement error`` and ``query`` records."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from granary.session import EngineSession


@dataclass
class Record:
    line: int
    kind: str
    options: list[str]
    sql: str
    expected: list[str] = field(default_factory=list)


def parse(text: str) -> list[Record]:
    records, block = [], []
    for number, line in enumerate([*text.splitlines(), ""], 1):
        if line.startswith("#"):
            continue
        if line.strip():
            block.append((number, line))
        elif block:
            records.append(_record(block))
            block = []
    return records


def _record(block: list[tuple[int, str]]) -> Record:
    number, head = block[0]
    kind, *options = head.split()
    if kind not in ("statement", "query"):
        raise ValueError(f"line {number}: unknown record {kind}")
    lines = [x for _, x in block[1:]]
    cut = lines.index("----") if "----" in lines else len(lines)
    return Record(number, kind, options, "\n".join(lines[:cut]), [" ".join(x.split()) for x in lines[cut + 1 :]])


def shown(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value)


def run_file(session: EngineSession, path: str | Path) -> int:
    """Runs every record of a file; raises AssertionError at the first that differs. Returns their number."""
    records = parse(Path(path).read_text())
    for r in records:
        where = f"{path}:{r.line}"
        if r.kind == "statement" and r.options[:1] == ["error"]:
            try:
                session.run(r.sql)
            except Exception:  # noqa: BLE001  any failure is what the record asks for
                continue
            raise AssertionError(f"{where}: should fail: {r.sql}")
        got = [" ".join(" ".join(map(shown, row)).split()) for row in session.run(r.sql)]
        if r.kind == "query":
            want = r.expected
            if "rowsort" in r.options:
                got, want = sorted(got), sorted(want)
            assert got == want, f"{where}: {got} != {want}"
    return len(records)
