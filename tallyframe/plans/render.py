"""Small results as text: a table, CSV or JSON. All cells are strings by now."""

from __future__ import annotations

from dataclasses import dataclass

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


@dataclass
class QueryResult:
    header: list[str]
    rows: list[list[str]]

    def __len__(self) -> int:
        return len(self.rows)

    def __str__(self) -> str:
        return self.to_text()

    def to_dicts(self) -> list[dict[str, str]]:
        return [dict(zip(self.header, r, strict=True)) for r in self.rows]

    def to_csv(self) -> str:
        def cell(x: str) -> str:
            return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x

        return "".join(",".join(map(cell, row)) + "\n" for row in [self.header, *self.rows])

    def to_json(self) -> str:
        def text(x: str) -> str:
            return '"' + "".join(_ESCAPES.get(c, c) for c in x) + '"'

        return "[" + ",".join("{" + ",".join(f"{text(h)}:{text(c)}" for h, c in zip(self.header, row, strict=True)) + "}" for row in self.rows) + "]"

    def to_text(self) -> str:
        widths = [max(len(x) for x in column) for column in zip(self.header, *self.rows, strict=True)]
        line = lambda row: "  ".join(c.ljust(n) for c, n in zip(row, widths, strict=True)).rstrip()
        return "\n".join([line(self.header), "  ".join("─" * n for n in widths), *map(line, self.rows)]) + "\n"
