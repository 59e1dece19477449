"""Problem 2: differences between two copies of data by characteristic-polynomial set reconciliation.

Each set of rows is a polynomial over GF(P) whose roots are its row hashes, split into buckets by row key. The sides
exchange only their values at a few points. The ratio of two values is a rational function in which common rows
cancel; interpolating it under a degree bound, checked at further points, gives the hashes of the rows that differ. The
bound doubles for buckets that fail the check. Only rows with recovered hashes are then fetched and compared by field.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weftline.functions.values import canonical_value
from weftline.operators.scale import hot_keys, is_small, salted_join, sized_join
from weftline.session import cut, spread

#: The field's prime; products of two elements fit into 64 bits. Fixed value.
P = 2**31 - 1
#: Evaluation points are P-1, P-2, ...; row hashes stay below P - RESERVED, so no point is a root.
RESERVED = 1 << 20
#: First degree bound, points for the check, and rows that a bucket has on average at most.
FIRST_BOUND, CHECKS, BUCKET_ROWS = 4, 2, 64


# --- polynomials over GF(P), lowest coefficient first


def _trim(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a.pop()
    return a


def _divmod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, out, inverse = a[:], [0] * max(0, len(a) - len(b) + 1), pow(b[-1], -1, P)
    for i in range(len(a) - len(b), -1, -1):
        if c := a[i + len(b) - 1] * inverse % P:
            out[i] = c
            for j, y in enumerate(b):
                a[i + j] = (a[i + j] - c * y) % P
    return _trim(out), _trim(a[: len(b) - 1])


def _gcd(a: list[int], b: list[int]) -> list[int]:
    while b:
        a, b = b, _divmod(a, b)[1]
    inverse = pow(a[-1], -1, P)
    return [x * inverse % P for x in a]


def _mulmod(a: list[int], b: list[int], m: list[int]) -> list[int]:
    out = [0] * (len(a) + len(b) - 1) if a and b else []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] = (out[i + j] + x * y) % P
    return _divmod(_trim(out), m)[1] if len(out) >= len(m) else _trim(out)


def _at(a: list[int], x: int) -> int:
    value = 0
    for c in reversed(a):
        value = (value * x + c) % P
    return value


def roots(a: list[int]) -> list[int] | None:
    """The distinct roots of a monic polynomial if it splits into linear factors, else None."""
    found: set[int] = set()
    work, rng = [a], random.Random(1)
    while work:
        f = work.pop()
        if len(f) == 1:
            continue
        if len(f) == 2:
            found.add(-f[0] * pow(f[1], -1, P) % P)
            continue
        if len(f) == 3:
            half = f[1] * pow(2 * f[2], -1, P) % P
            square = (half * half - f[0] * pow(f[2], -1, P)) % P
            root = pow(square, (P + 1) // 4, P)
            if root * root % P != square:
                return None
            found |= {(root - half) % P, (-root - half) % P}
            continue
        for _ in range(64):
            base, power, e = [rng.randrange(P), 1], [1], (P - 1) // 2
            while e:
                if e & 1:
                    power = _mulmod(power, base, f)
                base, e = _mulmod(base, base, f), e >> 1
            power = power or [0]
            part = _gcd(f, _trim([(power[0] - 1) % P, *power[1:]]) or f)
            if 1 < len(part) < len(f):
                work += [part, _divmod(f, part)[0]]
                break
        else:  # a power of one linear factor never splits: its root is -(next coefficient) / degree
            root = -f[-2] * pow((len(f) - 1) * f[-1], -1, P) % P
            if _at(f, root):
                return None
            found.add(root)
            work.append(_divmod(f, [-root % P, 1])[0])
    product = a
    for r in found:
        while len(product) > 1:
            q, rest = _divmod(product, [-r % P, 1])
            if rest:
                break
            product = q
    return sorted(found) if len(product) == 1 else None


def decode(ratios: list[int], surplus: int, bound: int) -> tuple[list[int], list[int]] | None:
    """(left-only hashes, right-only hashes) from L(x)/R(x) at P-1, P-2, ...; None if ``bound`` is too small.

    ``surplus`` is the number of left rows less that of right rows. Of the least degree that it allows one is tried first, as most
    buckets differ in a row or two; then ``bound`` points are solved. All other points check.
    """
    least = abs(surplus) or 2
    if least < bound and (found := _solved(ratios, surplus, least)) is not None:
        return found
    return _solved(ratios, surplus, bound) if abs(surplus) <= bound else None


def _solved(ratios: list[int], surplus: int, bound: int) -> tuple[list[int], list[int]] | None:
    b = (bound - surplus) // 2
    a = b + surplus
    n = a + b
    rows = []
    for i in range(n):
        x, r = P - 1 - i, ratios[i]
        powers = [1]
        for _ in range(max(a, b)):
            powers.append(powers[-1] * x % P)
        rows.append([*powers[:a], *(-r * y % P for y in powers[:b]), (r * powers[b] - powers[a]) % P])
    solution, pivots, rank = [0] * n, [], 0
    for c in range(n):
        at = next((i for i in range(rank, n) if rows[i][c]), None)
        if at is None:
            continue
        rows[rank], rows[at] = rows[at], rows[rank]
        inverse = pow(rows[rank][c], -1, P)
        top = rows[rank] = [v * inverse % P for v in rows[rank]]
        for i in range(n):
            if i != rank and (k := rows[i][c]):
                rows[i] = [(v - k * w) % P for v, w in zip(rows[i], top)]
        pivots.append(c)
        rank += 1
    if any(row[-1] for row in rows[rank:]):
        return None
    for i, c in enumerate(pivots):
        solution[c] = rows[i][-1]
    top, bottom = [*solution[:a], 1], [*solution[a:], 1]
    shared = _gcd(top, bottom)
    top, bottom = _divmod(top, shared)[0], _divmod(bottom, shared)[0]
    for i in range(len(ratios)):
        if _at(top, P - 1 - i) != ratios[i] * _at(bottom, P - 1 - i) % P:
            return None
    left, right = roots(top), roots(bottom)
    return None if left is None or right is None else (left, right)


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            values = [int(x) * pow(int(y), -1, P) % P for x, y in zip(r.le, r.re)]  # the row hashes avoid all points, so no value is 0
            found = decode(values, int(r.ln) - int(r.rn), int(r.bound))
            if found is None:
                out.append((r.pair_id, r.left_id, r.right_id, r.bucket, False, -1, False, r.le, r.re))
            else:
                out += [(r.pair_id, r.left_id, r.right_id, r.bucket, True, h, side, None, None) for side, hs in ((True, found[0]), (False, found[1])) for h in hs]
                if not found[0] and not found[1]:  # equal in the field, unlike in the checksum: fetch the whole bucket
                    out.append((r.pair_id, r.left_id, r.right_id, r.bucket, True, -1, False, None, None))
        yield pd.DataFrame(out, columns=["pair_id", "left_id", "right_id", "bucket", "solved", "h", "on_left", "le", "re"])


def _values(hashes: Column, points: range) -> Column:
    """The characteristic polynomial at the points of these numbers."""
    spots = F.array(*[F.lit(P - 1 - i) for i in points]).cast("array<bigint>")
    return F.transform(spots, lambda x: F.aggregate(hashes, F.lit(1).cast("bigint"), lambda acc, h: (acc * (x - h)) % F.lit(P).cast("bigint")))


def hashed_rows(rows: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(set_id, row_key, fields) with canonical field values, plus x64 and h: 64-bit and field hash of the row."""
    kept = F.map_filter("fields", lambda k, v: v.isNotNull() & ~k.isin(*ignored) if ignored else v.isNotNull())
    fields = F.transform_values(kept, lambda _, v: canonical_value(v))
    return (
        rows.select("set_id", F.coalesce("row_key", F.lit("")).alias("row_key"), fields.alias("fields"))
        .withColumn("x64", F.xxhash64("row_key", F.array_sort(F.map_entries("fields"))))
        .withColumn("h", F.pmod("x64", F.lit(P - RESERVED)).cast("bigint"))
    )


def _renamed(hot: list[Row], name: str) -> list[Row]:
    return [Row(**{name: r[0], "_salts": r["_salts"]}) for r in hot]


def _bucketed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(set_id, bucket, h, x64) of rows; sizes has the sets of more than one bucket with their number.

    Buckets go by contents, so that a row key that many rows share does not fill one.
    """
    slim = rows.select("set_id", "h", "x64", F.xxhash64(F.lit("bucket"), "x64").alias("_k"))
    placed = sized_join(slim, sizes, ["set_id"], "left", F.col("x64"))
    return placed.select("set_id", F.pmod("_k", F.coalesce("buckets", F.lit(1))).cast("int").alias("bucket"), "h", "x64")


def _sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("set_id", "bucket").agg(F.collect_list("h").alias("hs"), F.bit_xor("x64").alias("x"))


def reconcile(pairs: DataFrame, left: DataFrame, right: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(pair_id, row_key, field_name, diff_kind) for each pair of row sets that should be copies of each other.

    ``pairs`` has pair_id, left_id and right_id; a left set may belong to many pairs, a right set to one. ``left`` and ``right``
    have set_id, row_key STRING and fields MAP<STRING,STRING>. diff_kind is missing_in_right, missing_in_left (field_name is
    empty) or value_differs. A null field equals an absent one, blank text the empty string, numbers are equal by
    value; a null row_key counts as empty; fields named in ``ignored`` are left out. Rows repeated within a set count as
    often as they occur; of equal keys within a set each is compared with each. A set without rows is an empty set, pairs
    with a null left_id or right_id give nothing, empty inputs give no rows. Other columns are ignored.
    """
    pairs = cut(pairs.select("pair_id", "left_id", "right_id").where("left_id is not null and right_id is not null").distinct())
    hot = hot_keys(pairs, ["left_id"]).collect()
    left, right = cut(hashed_rows(left, ignored)), cut(hashed_rows(right, ignored))
    counts = lambda rows: rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    most = counts(right).withColumnRenamed("set_id", "right_id").join(pairs, "right_id").groupBy(F.col("left_id").alias("set_id")).agg(F.max("n").alias("n"))
    sizes = counts(left).unionByName(most).groupBy("set_id").agg(F.ceil(F.max("n") / F.lit(float(BUCKET_ROWS))).cast("int").alias("buckets")).where("buckets > 1")
    sizes = cut(sizes)
    spots = salted_join(pairs, sizes.withColumnRenamed("set_id", "left_id"), ["left_id"], "left", F.xxhash64("right_id"), hot=hot)
    right_sizes = cut(spots.where("buckets is not null").select(F.col("right_id").alias("set_id"), "buckets").distinct())
    ls = cut(_sketches(_bucketed(left, sizes)))
    rs = cut(_sketches(_bucketed(right, right_sizes)))

    spots = spots.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.coalesce("buckets", F.lit(1)) - 1))).drop("buckets")
    # Only buckets that are not solved are evaluated again, and only at points that are new.
    pending, bound, seen, solved, small = spots, FIRST_BOUND, 0, [], False
    while True:
        points = range(seen, bound + CHECKS)
        sides = []
        for name, table in (("l", ls), ("r", rs)):
            keys = ["left_id" if name == "l" else "right_id", "bucket"]
            table = table.withColumnRenamed("set_id", keys[0])
            table = sized_join(table, pending.select(*keys).distinct(), keys, "left_semi", small=small) if seen else table
            sides.append(table.select(*keys, F.size("hs").alias(name + "n"), F.col("x").alias(name + "x"), _values(F.col("hs"), points).alias(name + "v")))
        one = F.array(*[F.lit(1)] * len(points)).cast("array<bigint>")
        met = salted_join(pending, sides[0], ["left_id", "bucket"], "left", F.xxhash64("right_id"), hot=hot).join(sides[1], ["right_id", "bucket"], "left")
        values = {v: F.coalesce(v, one) for v in ("lv", "rv")}
        met = met.select(
            "pair_id", "left_id", "right_id", "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ln", "rn", "lx", "rx")],
            *[(F.concat(old, values[v]) if seen else values[v]).alias(old) for old, v in (("le", "lv"), ("re", "rv"))], F.lit(bound).alias("bound"),
        ).where("ln <> rn or lx <> rx or le <> re")
        result = cut(spread(met.drop("lx", "rx"), "pair_id", "bucket").mapInPandas(_decode_batches, _schema(pairs)))
        solved.append(result.where("solved").drop("le", "re"))
        pending = result.where("not solved").select("pair_id", "left_id", "right_id", "bucket", "le", "re")
        if pending.isEmpty():
            break
        small = small or is_small(pending.select("left_id", "right_id", "bucket"))
        seen, bound = bound + CHECKS, bound * 2
    found = solved[0]
    for more in solved[1:]:
        found = found.unionByName(more)
    return _compare(found, left, right, ls, rs, hot)


def _schema(pairs: DataFrame) -> str:
    kinds = dict(pairs.dtypes)
    return f"pair_id {kinds['pair_id']}, left_id {kinds['left_id']}, right_id {kinds['right_id']}, bucket int, solved boolean, h bigint, on_left boolean, le array<bigint>, re array<bigint>"


def _fetch(found: DataFrame, rows: DataFrame, side: str, hot: list[Row]) -> DataFrame:
    wanted = found.where(F.col("on_left") == (side == "left_id")).select("pair_id", F.col(side).alias("set_id"), "bucket", "h")
    if is_small(wanted):
        joined = rows.join(F.broadcast(wanted), ["set_id", "h"])
    else:
        joined = salted_join(wanted, rows, ["set_id", "h"], spread=F.xxhash64("pair_id"), hot=_renamed(hot, "set_id"))
    return joined.select("pair_id", "bucket", "row_key", "fields", "x64")


def _compare(found: DataFrame, left: DataFrame, right: DataFrame, ls: DataFrame, rs: DataFrame, hot: list[Row]) -> DataFrame:
    sides = {"left_id": (left, ls), "right_id": (right, rs)}
    got = {side: cut(_fetch(found, rows, side, hot if side == "left_id" else [])) for side, (rows, _) in sides.items()}
    # The 64-bit checksums of the rows fetched must explain the difference of the sets; a bucket where two rows share
    # a field hash fails this, and its pair is fetched as a whole.
    fetched = got["left_id"].select("pair_id", "bucket", "x64").unionByName(got["right_id"].select("pair_id", "bucket", "x64")).groupBy("pair_id", "bucket").agg(F.bit_xor("x64").alias("seen"))
    spots = found.select("pair_id", "left_id", "right_id", "bucket").distinct()
    told = salted_join(spots, ls.select(F.col("set_id").alias("left_id"), "bucket", F.col("x").alias("lx")), ["left_id", "bucket"], "left", F.xxhash64("right_id"), hot=hot)
    told = told.join(rs.select(F.col("set_id").alias("right_id"), "bucket", F.col("x").alias("rx")), ["right_id", "bucket"], "left").join(fetched, ["pair_id", "bucket"], "left")
    bad = cut(told.where("(coalesce(lx, 0L) ^ coalesce(rx, 0L)) <> coalesce(seen, 0L)").select("pair_id", "left_id", "right_id", "bucket"))
    if not bad.isEmpty():
        for side, (rows, _) in sides.items():
            whole = salted_join(bad.select("pair_id", F.col(side).alias("set_id")).distinct(), rows, ["set_id"], spread=F.xxhash64("pair_id"), hot=_renamed(hot, "set_id") if side == "left_id" else [])
            got[side] = got[side].join(bad.select("pair_id").distinct(), "pair_id", "left_anti").unionByName(whole.select("pair_id", F.lit(0).alias("bucket"), "row_key", "fields", "x64"))
    a = got["left_id"].select("pair_id", "row_key", F.col("fields").alias("lf"))
    b = got["right_id"].select("pair_id", "row_key", F.col("fields").alias("rf"))
    both = a.join(b, ["pair_id", "row_key"], "full")
    names = F.array_union(F.map_keys("lf"), F.map_keys("rf"))
    differing = F.filter(names, lambda k: ~F.try_element_at("lf", k).eqNullSafe(F.try_element_at("rf", k)))
    kinds = (
        F.when(F.col("rf").isNull(), F.array(F.struct(F.lit("").alias("field_name"), F.lit("missing_in_right").alias("diff_kind"))))
        .when(F.col("lf").isNull(), F.array(F.struct(F.lit("").alias("field_name"), F.lit("missing_in_left").alias("diff_kind"))))
        .otherwise(F.transform(differing, lambda k: F.struct(k.alias("field_name"), F.lit("value_differs").alias("diff_kind"))))
    )
    return both.select("pair_id", "row_key", F.explode(kinds).alias("d")).select("pair_id", "row_key", "d.field_name", "d.diff_kind").distinct()
