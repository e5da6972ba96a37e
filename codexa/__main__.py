"""python -m codexa PATH: metadata, resources and text of the books below a path."""

from __future__ import annotations

import sys

from codexa.session import local_session
from codexa.sources import reader


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m codexa PATH", file=sys.stderr)
        return 2
    spark = local_session(name="codexa")
    parsed = reader.read_books(spark, args[0]).cache()
    reader.books(parsed).show(vertical=True, truncate=200)
    reader.resources(parsed).drop("content").show(1000, truncate=60)
    for r in reader.book_texts(parsed).toLocalIterator():
        print(f"--- {r.book_id}\n{r.text if r.text is not None else r.error_code}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
