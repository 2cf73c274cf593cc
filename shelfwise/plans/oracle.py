"""DuckDB SQL building blocks for the oracle texts.

Each oracle statement is ``WITH <adapter views>, <blocks used> <body>``.
Floating literals are cast to DOUBLE (a bare 0.5 is DECIMAL in both engines);
doubles are rounded to 6 places in the final SELECT, as on the Spark side.
"""

from __future__ import annotations

from shelfwise.sources.testdata import ADAPTER_VIEWS, RAW_TABLES, view_sql

D = "CAST({} AS DOUBLE)".format

# name -> (SQL, dependencies)
BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {
    "inter": ("""
SELECT user_id, book_id, created_at AS ts, CAST(rating_value AS DOUBLE) AS strength, 'rating' AS type FROM ratings
UNION ALL
SELECT user_id, book_id, last_read_at AS ts,
       CAST(greatest(CAST(1.0 AS DOUBLE), coalesce(progress / CAST(100.0 AS DOUBLE), CAST(0.5 AS DOUBLE)) * CAST(5.0 AS DOUBLE)) AS DOUBLE) AS strength,
       'history' AS type FROM reading_history
UNION ALL
SELECT user_id, book_id, added_at AS ts, CAST(5.0 AS DOUBLE) AS strength, 'favorite' AS type FROM favorites""",
              ("ratings", "reading_history", "favorites")),
    "store": ("""
SELECT user_id, book_id, sum(strength) AS total,
       sum(CASE WHEN type = 'rating' THEN strength END) AS rating,
       sum(CASE WHEN type = 'history' THEN strength END) AS history,
       sum(CASE WHEN type = 'favorite' THEN strength END) AS favorite
FROM inter GROUP BY user_id, book_id""", ("inter",)),
    # The content model's vectors: live books only.
    "emb": ("""
SELECT book_id, CAST(embedding AS DOUBLE[]) AS e FROM item_embeddings
WHERE book_id IN (SELECT book_id FROM books WHERE is_deleted = FALSE)""", ("item_embeddings", "books")),
    "seen": ("SELECT DISTINCT user_id, book_id FROM inter", ("inter",)),
    "live": ("""
SELECT book_id, title, description, publisher, publication_year FROM books WHERE is_deleted = FALSE""",
             ("books",)),
    "by_author": ("""
SELECT ba.book_id, string_agg(DISTINCT a.author_name, ' ' ORDER BY a.author_name) AS authors_text
FROM book_authors ba JOIN authors a ON a.author_id = ba.author_id GROUP BY ba.book_id""",
                  ("book_authors", "authors")),
    "by_genre": ("""
SELECT bg.book_id, string_agg(DISTINCT g.genre_name, ' ' ORDER BY g.genre_name) AS genres_text
FROM book_genres bg JOIN genres g ON g.genre_id = bg.genre_id GROUP BY bg.book_id""",
                 ("book_genres", "genres")),
    "catalog": ("""
SELECT l.book_id, l.title, l.description, l.publisher, l.publication_year,
       coalesce(a.authors_text, '') AS authors_text, coalesce(g.genres_text, '') AS genres_text
FROM live l LEFT JOIN by_author a USING (book_id) LEFT JOIN by_genre g USING (book_id)""",
                ("live", "by_author", "by_genre")),
    "pop": ("SELECT book_id, count(*) AS cnt FROM inter GROUP BY book_id", ("inter",)),
}



def profile_blocks(prefix: str = "", store: str = "store") -> dict:
    """D4 in SQL over ``store`` (user_id, book_id, total): blocks <prefix>pw .. <prefix>prof."""
    p = prefix
    return {
        f"{p}pw": (f"SELECT s.user_id, s.total AS w, m.e FROM {store} s JOIN emb m USING (book_id)", (store, "emb")),
        f"{p}pws": (f"SELECT user_id, sum(w) AS wsum FROM {p}pw GROUP BY user_id HAVING sum(w) <> 0", (f"{p}pw",)),
        f"{p}pe": (f"SELECT user_id, w, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS pos FROM {p}pw", (f"{p}pw",)),
        f"{p}pm": (f"""
SELECT x.user_id, x.pos, sum(x.w * x.v) / any_value(y.wsum) AS m
FROM {p}pe x JOIN {p}pws y USING (user_id) GROUP BY x.user_id, x.pos""", (f"{p}pe", f"{p}pws")),
        f"{p}pn": (f"SELECT user_id, sqrt(sum(m * m)) AS nrm FROM {p}pm GROUP BY user_id HAVING sqrt(sum(m * m)) > 0",
                   (f"{p}pm",)),
        f"{p}plong": (f"SELECT user_id, pos, m / nrm AS value FROM {p}pm JOIN {p}pn USING (user_id)",
                      (f"{p}pm", f"{p}pn")),
        f"{p}prof": (f"SELECT user_id, list(value ORDER BY pos) AS p FROM {p}plong GROUP BY user_id", (f"{p}plong",)),
    }


BLOCKS.update(profile_blocks())

_ADAPTER = {n for n, _ in ADAPTER_VIEWS}


def sql(body: str, *uses: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """Compose ``WITH`` adapter views + blocks (+ ``extra`` local blocks) and ``body``."""
    local = dict(extra or {})
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        if n in local:
            for d in local[n][1]:
                visit(d)
        elif n in BLOCKS:
            for d in BLOCKS[n][1]:
                visit(d)
        elif n in RAW_TABLES:
            return
        elif n not in _ADAPTER:
            raise KeyError(n)
        order.append(n)

    for n in uses + tuple(local):
        visit(n)
    parts = []
    for n in order:
        if n in local:
            text = local[n][0]
        elif n in BLOCKS:
            text = BLOCKS[n][0]
        else:
            text = view_sql(n, "duckdb")
        parts.append(f"{n} AS ({text.strip()})")
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
