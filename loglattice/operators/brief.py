"""Plain-text briefs of a bounded result: everything as it is if it fits, else the chosen records with what was left out."""

from __future__ import annotations

from collections.abc import Sequence


def _shown(raw: bytes) -> str:
    """Printable ASCII as it is, everything else as \\xNN, so that a brief is one line per line and can be read back."""
    return "".join(chr(b) if 0x20 <= b <= 0x7E and b != 0x5C else f"\\x{b:02x}" for b in raw)


def passthrough(records: Sequence[tuple[str, bytes]], budget: int) -> str | None:
    """All records, or None if they don't fit the budget of bytes."""
    text = "\n".join(["# all records", *[f"{i} {_shown(raw)}" for i, raw in records]]) + "\n"
    return text if len(text) <= budget else None


def compiled(records: Sequence[tuple[str, bytes]], chosen: Sequence[str], roles: dict[str, str], budget: int) -> str:
    """The chosen records in source order under aliases E1, E2, ..., then counts of what is and isn't shown."""
    wanted = set(chosen)
    if not wanted <= {i for i, _ in records}:
        raise ValueError("a chosen record isn't among the records")
    lines = ["# chosen records"]
    for n, (i, raw) in enumerate(((i, r) for i, r in records if i in wanted), 1):
        lines.append(f"E{n} {i} {roles.get(i, 'context')} {_shown(raw)}")
    left = [raw for i, raw in records if i not in wanted]
    lines.append(f"# shown {len(wanted)} of {len(records)} records; {sum(map(len, left))} bytes in {len(left)} records not shown")
    text = "\n".join(lines) + "\n"
    if len(text) > budget:
        raise ValueError("the brief passes its budget")
    return text
