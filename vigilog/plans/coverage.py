"""Print which named query covers which inventory row."""

from collections import defaultdict

from vigilog.plans.queries import QUERIES


def main() -> None:
    rows = defaultdict(list)
    for name, q in QUERIES.items():
        for row in q.rows.split():
            rows[row].append(name + ("" if q.check else " (rows only)"))
    for row in sorted(rows, key=lambda r: (r[0], int(r[1:]))):
        print(f"{row:4} {', '.join(rows[row])}")


if __name__ == "__main__":
    main()
