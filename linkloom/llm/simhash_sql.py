"""DuckDB SQL for the rows of op9: XXH64 of every shingle in 128-bit arithmetic, bits by majority, links between all pairs."""

from __future__ import annotations

MASK = f"{(1 << 64) - 1}::UHUGEINT"
#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def number(x: int) -> str:
    return f"{x % (1 << 64)}::UHUGEINT"


def times(a: str, b: int) -> str:
    return f"(({a}) * {number(b)} & {MASK})"


def plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) & {MASK})"


def turned(x: str, by: int) -> str:
    return f"((({x}) * {number(1 << by)} & {MASK}) + (({x}) >> {64 - by}::UHUGEINT))"


def lane(at: str, n: int) -> str:
    """n bytes from byte `at` on, the lowest first, of the hexadecimal text b."""
    return "('0x' || " + " || ".join(f"substr(b, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def round_of(v: str, k: str) -> str:
    return times(turned(plus(v, times(k, P2)), 31), P1)


def let(value: str, name: str, out: str) -> str:
    return f"list_transform([{value}], lambda {name}: {out})[1]"


def xxh64(seed: int) -> str:
    """The hash of n bytes whose hexadecimal digits are b."""
    start = f"{{'v1': {number(seed + P1 + P2)}, 'v2': {number(seed + P2)}, 'v3': {number(seed)}, 'v4': {number(seed - P1)}}}"
    stripe = ", ".join(f"'v{j + 1}': {round_of(f'a.v{j + 1}', lane(f'32 * i + {8 * j}', 8))}" for j in range(4))
    mixed = "(" + " + ".join(turned(f"a.v{j + 1}", by) for j, by in enumerate((1, 7, 12, 18))) + f") & {MASK}"
    merged = f"list_reduce([a.v1, a.v2, a.v3, a.v4], lambda h, v: {plus(times(f'xor(h, {round_of(number(0), "v")})', P1), number(P4))}, {mixed})"
    h = f"CASE WHEN n >= 32 THEN {let(f'list_reduce(range(n // 32), lambda a, i: {{{stripe}}}, {start})', 'a', merged)} ELSE {number(seed + P5)} END"
    h = plus(h, "n::UHUGEINT")
    eights = plus(times(turned(f"xor(h, {round_of(number(0), lane('n // 32 * 32 + 8 * i', 8))})", 27), P1), number(P4))
    fours = plus(times(turned(f"xor(h, {times(lane('n // 8 * 8', 4), P1)})", 23), P2), number(P3))
    ones = times(turned(f"xor(h, {times(lane('n // 4 * 4 + i', 1), P5)})", 11), P1)
    for many, step in (("n % 32 // 8", eights), ("n % 8 // 4", fours), ("n % 4", ones)):
        h = f"list_reduce(range({many}), lambda h, i: {step}, {h})"
    for by, p in ((33, P2), (29, P3), (32, 1)):
        h = let(h, "h", times(f"xor(h, (h >> {by}::UHUGEINT))", p))
    return h


def oracle(words: int = 4, seed: int = 42, radius: int = 4) -> str:
    bits = ", ".join(f"count(*) FILTER (h & {1 << k}::UBIGINT > 0) AS b{k}" for k in range(64))
    total = " + ".join(f"CASE WHEN 2 * b{k} > c THEN {number(1 << k)} ELSE 0::UHUGEINT END" for k in range(64))
    low = "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{low.upper()}', '{low}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) <= {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) END) AS g FROM t WHERE len(w) > 0),
        u AS (SELECT g, hex(encode(g)) AS b, strlen(g) AS n FROM (SELECT DISTINCT g FROM s)),
        x AS (SELECT g, ({xxh64(seed)})::UBIGINT AS h FROM u),
        k AS (SELECT doc_id, count(*) AS c, {bits} FROM s JOIN x USING (g) GROUP BY 1),
        f AS (SELECT doc_id, coalesce(v, 0::UHUGEINT)::UBIGINT AS fp FROM t LEFT JOIN (SELECT doc_id, {total} AS v FROM k) USING (doc_id)),
        c AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY 1),
        l AS (SELECT a.fp AS u, b.fp AS v FROM c a JOIN c b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::BIT) <= {radius}),
        r AS (SELECT fp AS u, least FROM c UNION SELECT l.v, r.least FROM r JOIN l ON l.u = r.u),
        m AS (SELECT u, min(least) AS component_id FROM r GROUP BY 1)
        SELECT f.doc_id, lpad(lower(to_hex(f.fp)), 16, '0') AS fingerprint, m.component_id FROM f JOIN m ON m.u = f.fp"""
