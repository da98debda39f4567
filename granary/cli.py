"""A read-eval-print loop: ``python -m granary.cli [data directory]``."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from granary.session import EngineSession
from granary.slt import shown
from granary.sources.parquet import register_views

HELP = "Enter one SQL statement a line. 'show tables' lists tables, '?' prints this help, 'quit' leaves."


def respond(session: EngineSession, line: str) -> str | None:
    """The text that answers one line; None ends the loop."""
    text = line.strip().rstrip(";").strip()
    if text.lower() in ("quit", "exit"):
        return None
    if not text:
        return ""
    if text in ("?", "help"):
        return HELP
    if text.lower() == "show tables":
        return "\n".join(session.tables()) or "no tables"
    try:
        df = session.sql(text)
        rows = df.collect()
    except Exception as e:  # noqa: BLE001  a prompt survives any failed statement
        return f"error: {str(e).splitlines()[0]}"
    if df.columns[:2] == ["header", "affected_rows"] and len(rows) == 1:
        return f"rows affected {rows[0].affected_rows}"
    if not rows:
        return "Empty ResultSet"
    return "\n".join(["|".join(df.columns), *("|".join(map(shown, r)) for r in rows)])


def loop(session: EngineSession, lines: Iterable[str], write=print) -> None:
    for line in lines:
        answer = respond(session, line)
        if answer is None:
            return
        if answer:
            write(answer)


def main() -> None:
    spark = SparkSession.builder.appName("granary").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session = EngineSession(spark)
    if len(sys.argv) > 1:
        register_views(session.spark, sys.argv[1])
    print(HELP)
    loop(session, sys.stdin)


if __name__ == "__main__":
    main()
