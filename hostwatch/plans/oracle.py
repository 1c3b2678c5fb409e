"""Plain SQL for the registered queries, composed from shared WITH clauses."""

from __future__ import annotations

from . import oracle_sql_text as text


def build() -> dict[str, str]:
    out = {}
    for name, body in text.QUERIES.items():
        needed, seen = [], set()

        def visit(cte):
            if cte in seen:
                return
            seen.add(cte)
            for other in text.CTES:
                if other != cte and _mentions(text.CTES[cte], other):
                    visit(other)
            needed.append(cte)

        for cte in text.CTES:
            if _mentions(body, cte):
                visit(cte)
        body = body.strip()
        clauses = [f"{c} AS (\n{text.CTES[c].strip()}\n)" for c in needed]
        if body.upper().startswith("WITH RECURSIVE "):
            out[name] = "WITH RECURSIVE " + ",\n".join(clauses + [body[15:]])
        elif body.upper().startswith("WITH "):
            out[name] = "WITH " + ",\n".join(clauses + [body[5:]])
        else:
            out[name] = ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body
    # reported doubles are nudged off exact rounding ties, here and in round_doubles
    return {k: sql.replace(",6)+0.0", "+1e-9,6)+0.0") for k, sql in out.items()}


def _mentions(sql: str, name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", sql) is not None
