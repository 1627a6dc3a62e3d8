"""One SQL text for Spark and for DuckDB: the few places where their functions differ."""

from __future__ import annotations


class Spark:
    """Tables are Parquet files of a folder."""

    def __init__(self, sf_dir: str):
        self.dir = sf_dir

    def t(self, name: str) -> str:
        return f"parquet.`{self.dir}/{name}.parquet`"

    def epoch(self, x):
        return f"unix_seconds(CAST({x} AS TIMESTAMP))"

    def idiv(self, a, b):
        return f"(({a}) div ({b}))"

    def arr(self, *x):
        return f"array({', '.join(x)})"

    def has(self, a, x):
        return f"array_contains({a}, {x})"

    def overlap(self, a, b):
        return f"arrays_overlap({a}, {b})"

    def contains_all(self, a, b):
        return f"size(array_except({b}, {a})) = 0"

    def join_sorted(self, x, distinct=False):
        return f"array_join(sort_array(collect_{'set' if distinct else 'list'}(CAST({x} AS STRING))), ',')"

    def ordered(self, x, by, sep):
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {by})"

    def month(self, x):
        return f"month({x})"

    def isodow(self, x):
        return f"(weekday({x}) + 1)"

    def dow(self, x):
        return f"(dayofweek({x}) - 1)"

    def argmax(self, x, by):
        return f"max_by({x}, {by})"

    def argmin(self, x, by):
        return f"min_by({x}, {by})"

    def ts(self, text):
        return f"TIMESTAMP_NTZ '{text}'"

    def json(self, x, key):
        return f"get_json_object({x}, '$.{key}')"

    def regex(self, x, p):
        return f"({x}) RLIKE '{p}'"

    def unnest(self, a, name):
        return f"LATERAL VIEW explode({a}) ex AS {name}"

    def size(self, a):
        return f"size({a})"

    def split(self, x, p):
        return f"split({x}, '{p}')"

    def to_text(self, x):
        return f"date_format({x}, 'yyyy-MM-dd HH:mm:ss')"


class Duck(Spark):
    """Tables are registered views."""

    def __init__(self):
        super().__init__("")

    def t(self, name):
        return name

    def epoch(self, x):
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    def idiv(self, a, b):
        return f"(({a}) // ({b}))"

    def arr(self, *x):
        return f"[{', '.join(x)}]"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def contains_all(self, a, b):
        return f"list_has_all({a}, {b})"

    def join_sorted(self, x, distinct=False):
        return f"array_to_string(list_sort(list({'DISTINCT ' if distinct else ''}CAST({x} AS VARCHAR))), ',')"

    def ordered(self, x, by, sep):
        return f"string_agg({x}, '{sep}' ORDER BY {by})"

    def isodow(self, x):
        return f"isodow({x})"

    def dow(self, x):
        return f"dayofweek({x})"

    def argmax(self, x, by):
        return f"arg_max({x}, {by})"

    def argmin(self, x, by):
        return f"arg_min({x}, {by})"

    def ts(self, text):
        return f"TIMESTAMP '{text}'"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"

    def regex(self, x, p):
        return f"regexp_matches({x}, '{p}')"

    def unnest(self, a, name):
        return f", unnest({a}) ex({name})"

    def size(self, a):
        return f"len({a})"

    def split(self, x, p):
        return f"string_split_regex({x}, '{p}')"

    def to_text(self, x):
        return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
