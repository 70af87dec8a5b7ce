"""Names of join paths: steps `from|from_column|to_column|to` after the base, put together by `--`."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Step:
    source: str
    source_column: str
    target_column: str
    target: str

    def __str__(self) -> str:
        return "|".join((self.source, self.source_column, self.target_column, self.target))


def extend(path: str, step: Step) -> str:
    return f"{path}--{step}"


def parse(path: str) -> tuple[str, list[Step]]:
    """The base table and the steps; a step without four fields is an error."""
    base, *steps = path.split("--")
    out = []
    for s in steps:
        fields = s.split("|")
        if len(fields) != 4:
            raise ValueError(f"step {s!r} has {len(fields)} fields")
        out.append(Step(*fields))
    return base, out


def length(path: str) -> int:
    return len(parse(path)[1])


def needed(steps: list[Step], owners: set[str]) -> list[Step]:
    """The steps to tables that own wanted columns and to those on the way to them."""
    by_target = {s.target: s for s in steps}
    keep: set[str] = set()
    for table in owners:
        while table in by_target and table not in keep:
            keep.add(table)
            table = by_target[table].source
    return [s for s in steps if s.target in keep]


def best_paths(ranking: dict[str, float], k: int = 15) -> list[str]:
    """The k best by rank, then the shorter, then by name; a base alone counts but isn't returned."""
    order = sorted(ranking, key=lambda p: (-ranking[p], length(p), p))[:k]
    return [p for p in order if length(p)]
