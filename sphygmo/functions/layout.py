"""The layout of delimited text, line by line: widths, where data begin, header, metadata, columns without gaps."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

#: Gives a text's lines from the start, as often as it is called: a large file is read again, not held.
Lines = Callable[[], Iterable[str]]
#: Lines that must look like data from the first on, and lines above them among which the header is sought.
STEADY, ABOVE = 5, 3


def number(token: str) -> float | None:
    try:
        return float(token)
    except ValueError:
        return None


def delimiter(lines: Iterable[str]) -> str:
    """Of the first 20 lines: tab if there is one, else the most frequent, ties in the order , ; space."""
    head = [x for x in islice(lines, 20) if x.strip()]
    count = {d: sum(x.count(d) for x in head) for d in (",", ";", "\t", " ")}
    return "\t" if count["\t"] else max(count, key=lambda d: count[d]) if any(count.values()) else ","


def tokens(line: str, by: str) -> list[str]:
    """A line's tokens, white space at its ends cut off; one empty token at the end is dropped; runs of white space part
    tokens if the delimiter is a space."""
    found = line.strip().split(None if by == " " else by)
    return found[:-1] if found and found[-1] == "" else found


@dataclass
class Column:
    """What is known of a column once all of it was seen; gaps filled as in :meth:`Layout.rows`."""

    name: str
    numbers: int = 0
    first: float = 0.0
    first_row: int = -1
    last: float = 0.0
    last_row: int = -1
    rising: bool = True


@dataclass
class Layout:
    """How a text is laid out; ``error`` says why it cannot be loaded."""

    by: str = ","
    width: int = 0
    start: int = 0
    header_no: int = -1
    columns: list[Column] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    metadata: list[tuple[str, str]] = field(default_factory=list)
    n_rows: int = 0
    error: str | None = None

    def numbers(self, lines: Lines) -> Iterator[list[float | None]]:
        """The data as they stand: finite numbers of the named columns, None for all else and for what is missing."""
        for line in islice(lines(), self.start, None):
            found = tokens(line, self.by)
            if found:
                row = [number(found[k]) if k < len(found) else None for k in self.places]
                yield [v if v is not None and abs(v) < float("inf") else None for v in row]

    def rows(self, lines: Lines) -> Iterator[list[float]]:
        """The data without gaps: linear between numbers, ends by the nearest, columns without numbers 0.

        Rows are held only while a gap inside a column is open.
        """
        held: deque[list] = deque()
        known = [c.first for c in self.columns]
        at = [-1] * len(self.columns)
        for k, row in enumerate(self.numbers(lines)):
            held.append(row)
            for j, c in enumerate(self.columns):
                if row[j] is None:
                    if k < c.first_row or k > c.last_row:  # also where there is no number at all
                        row[j] = c.first if k < c.first_row else c.last
                    continue
                gap = k - at[j] - 1
                if gap and k > c.first_row:
                    step = (row[j] - known[j]) / (gap + 1)
                    for i in range(1, gap + 1):
                        held[len(held) - 1 - gap - 1 + i][j] = known[j] + step * i
                known[j], at[j] = row[j], k
            while held and None not in held[0]:
                yield held.popleft()


def _data_start(lines: Iterable[str], by: str, width: int) -> int:
    """The first line from which on no line of :data:`STEADY` (blank ones aside) is not as wide as most or has more than one
    token that is no number; 0 if none."""
    first = None
    for k, line in enumerate(lines):
        if first is not None and k >= first + STEADY:
            return first
        found = tokens(line, by)
        if not line.strip():
            continue
        if len(found) == width and sum(number(t) is not None for t in found) >= width - 1:
            first = k if first is None else first
        else:
            first = None
    return first or 0


def _header(lines: Iterable[str], layout: Layout) -> tuple[list[str] | None, int]:
    """The header's tokens, and the line where metadata end: at the header, else at the first line passed over for it, else
    at the data."""
    near = list(enumerate(islice(lines, layout.start)))[-ABOVE:]
    odd = []
    for k, line in reversed(near):
        found = tokens(line, layout.by)
        if len(found) != layout.width or not found:
            continue
        if sum(number(t) is None for t in found) >= layout.width // 2 or layout.width == 1:
            if found[0] == "" or any("sample" in t.lower() or "count" in t.lower() for t in found):
                odd.append(k)
            else:
                layout.header_no = k
                return found, k
    return None, min(odd, default=layout.start)


def laid_out(lines: Lines, by: str | None = None, name: str = "") -> Layout:
    """The layout of a text: its lines are gone through for the widths, for the data's start, and for the columns."""
    out = Layout(by if by is not None else delimiter(lines()))
    widths = Counter(len(tokens(x, out.by)) for x in lines() if x.strip())
    if not widths:
        out.error = f"No delimited data found in file {name}"
        return out
    out.width = widths.most_common(1)[0][0]
    out.start = _data_start(lines(), out.by, out.width)
    header, end = _header(lines(), out)
    for k, line in enumerate(islice(lines(), end)):
        if text := line.strip():
            key, colon, value = text.partition(":")
            out.metadata.append((key.strip(), value.strip()) if colon else (f"meta_line_{k}", text))
    names = [t.strip().strip("\"'") for t in header] if header else [f"col_{k}" for k in range(out.width)]
    # a name that comes again is told apart by its number, as columns of one frame
    seen: Counter[str] = Counter()
    for k, n in enumerate(names):
        if n:
            out.columns.append(Column(n if not seen[n] else f"{n}.{seen[n]}"))
            out.places.append(k)
            seen[n] += 1
    for row in out.numbers(lines):
        for v, c in zip(row, out.columns, strict=True):
            if v is None:
                continue
            if not c.numbers:
                c.first, c.first_row = v, out.n_rows
            elif v <= c.last:
                c.rising = False
            c.numbers, c.last, c.last_row = c.numbers + 1, v, out.n_rows
        out.n_rows += 1
    for c in out.columns:  # ends filled by the nearest do not rise
        c.rising = c.rising and out.n_rows > 1 and c.numbers > 0 and (c.first_row, c.last_row) == (0, out.n_rows - 1)
    return out
