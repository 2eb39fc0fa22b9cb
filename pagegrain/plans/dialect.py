"""The few expressions that Spark SQL and DuckDB write differently.

Operators are SQL over named views; the same text is bound to a Spark session and, for
checks, to DuckDB.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def floordiv(self, a, b):
        return f"cast(floor({a} / {b}) as bigint)"

    def bround(self, x, digits=0):
        return f"cast(bround(cast({x} as double), {digits}) as double)"

    def matches(self, text, pattern):
        return f"({text} rlike r'{pattern}')"

    def replace_all(self, text, pattern, by):
        return f"regexp_replace({text}, r'{pattern}', '{by}')"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def joined(self, x, sep, order):
        return f"listagg({x}, '{sep}') within group (order by {order})"

    def series(self, a, b, name, table="s"):
        return f"lateral view explode(case when {b} >= {a} then sequence(cast({a} as bigint), cast({b} as bigint)) else array() end) {table} as {name}"

    def split(self, text, sep, name, pos, table="s"):
        return f"lateral view posexplode(split({text}, r'{sep}', -1)) {table} as {pos}, {name}"

    def values(self, table, cols, rows):
        return f"(select * from values {', '.join(rows)} as {table}({cols}))"

    def json_int(self, col, key):
        return f"cast(get_json_object({col}, '$.{key}') as bigint)"

    def array_rows(self, array, name, pos, table="s"):
        """Elements and their places from 0."""
        return f"lateral view posexplode({array}) {table} as {pos}, {name}"

    def hypot_deg(self, dy, dx):
        return f"degrees(atan2({dy}, {dx}))"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def first_int(self, x):
        return f"cast({x} as bigint)"

    def extract(self, text, pattern, group=0):
        return f"regexp_extract({text}, r'{pattern}', {group})"

    def try_int(self, x):
        return f"try_cast({x} as bigint)"


class Duck(Spark):
    name = "duckdb"

    def bround(self, x, digits=0):
        return f"round_even(cast({x} as double), {digits})"

    def matches(self, text, pattern):
        return f"regexp_matches({text}, '{pattern}')"

    def replace_all(self, text, pattern, by):
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def sha(self, x):
        return f"sha256({x})"

    def joined(self, x, sep, order):
        return f"string_agg({x}, '{sep}' order by {order})"

    def series(self, a, b, name, table="s"):
        return f", unnest(range(cast({a} as bigint), cast({b} as bigint) + 1)) as {table}({name})"

    def split(self, text, sep, name, pos, table="s"):
        parts = f"regexp_split_to_array({text}, '{sep}')"
        return f", (select unnest({parts}) as {name}, unnest(range(len({parts}))) as {pos}) as {table}"

    def values(self, table, cols, rows):
        return f"(select * from (values {', '.join(rows)}) as {table}({cols}))"

    def json_int(self, col, key):
        return f"cast(json_extract({col}, '$.{key}') as bigint)"

    def array_rows(self, array, name, pos, table="s"):
        return f", (select unnest({array}) as {name}, unnest(range(len({array}))) as {pos}) as {table}"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def extract(self, text, pattern, group=0):
        return f"regexp_extract({text}, '{pattern}', {group})"


SPARK, DUCK = Spark(), Duck()
