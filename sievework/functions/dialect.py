"""The few expressions that Spark SQL and DuckDB write differently.

Queries of this package are stated once as SQL text; Spark runs them through DataFrames, and the correctness check runs the same statement in DuckDB."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        """A literal, taken as it stands."""
        return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'

    def rx(self, x: str, pattern: str, nocase: bool = False) -> str:
        return f"regexp_like({x}, {self.text(('(?i)' if nocase else '') + pattern)})"

    def rx_extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def rx_replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def rx_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def rx_count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, {self.text(pattern)}) as bigint)"

    def head(self, x: str, n: int) -> str:
        """Upper-case hex of the first n bytes of the text."""
        return f"hex(substring(encode(left({x}, {n}), 'UTF-8'), 1, {n}))"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def hex_number(self, x: str) -> str:
        return f"lower(hex({x}))"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def any_of(self, array: str, var: str, test: str) -> str:
        return f"exists({array}, {var} -> {test})"

    def kept(self, array: str, var: str, test: str) -> str:
        return f"filter({array}, {var} -> {test})"

    def each(self, array: str, var: str, out: str) -> str:
        return f"transform({array}, {var} -> {out})"

    def distinct_sorted(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))"

    def first_n(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, r'\\Q{by}\\E')"

    def array(self, items: str) -> str:
        return f"array({items})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')"

    def unnest(self, array: str, alias: str) -> str:
        return f"explode({array}) as {alias}"

    def series(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def fired_struct(self, r: str) -> str:
        """A fired rule without hits and pairs, with the type of one with some."""
        hit, pair = "struct<ord:int,place:bigint,string:string,grp:string,text:string>", "struct<distance:bigint,group_a:string,group_b:string,at:bigint>"
        return f"named_struct('rule_no', {r}, 'hits', cast(array() as array<{hit}>), 'near', cast(array() as array<{pair}>))"

    def empty_fired(self) -> str:
        """No fired rules, with the type of some."""
        return f"slice(array({self.fired_struct('0')}), 1, 0)"

    def latin(self, x: str) -> str:
        """The text's UTF-8 bytes, one character a byte."""
        return f"decode(encode({x}, 'UTF-8'), 'ISO-8859-1')"

    def middle(self, array: str) -> str:
        """The elements but the first and last."""
        return f"slice({array}, 2, greatest(size({array}) - 2, 0))"


class DuckDB(Spark):
    name = "duckdb"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rx(self, x: str, pattern: str, nocase: bool = False) -> str:
        return f"regexp_matches({x}, {self.text(('(?i)' if nocase else '') + pattern)})"

    def rx_replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def rx_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def rx_count(self, x: str, pattern: str) -> str:
        return f"len({self.rx_all(x, pattern)})"

    def head(self, x: str, n: int) -> str:
        return f"left(hex(encode(left({x}, {n}))), {2 * n})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def any_of(self, array: str, var: str, test: str) -> str:
        return f"(len(list_filter({array}, lambda {var}: {test})) > 0)"

    def kept(self, array: str, var: str, test: str) -> str:
        return f"list_filter({array}, lambda {var}: {test})"

    def each(self, array: str, var: str, out: str) -> str:
        return f"list_transform({array}, lambda {var}: {out})"

    def distinct_sorted(self, array: str) -> str:
        return f"list_sort(list_distinct({array}))"

    def first_n(self, array: str, n: int) -> str:
        return f"{array}[1:{n}]"

    def size(self, array: str) -> str:
        return f"len({array})"

    def split(self, x: str, by: str) -> str:
        return f"string_split({x}, '{by}')"

    def array(self, items: str) -> str:
        return f"[{items}]"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, '{by}')"

    def unnest(self, array: str, alias: str) -> str:
        return f"unnest({array}) as {alias}"

    def series(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def latin(self, x: str) -> str:
        return f"CASE WHEN strlen({x}) = length({x}) THEN {x} ELSE array_to_string(list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: chr(cast('0x' || h AS INTEGER))), '') END"

    def middle(self, array: str) -> str:
        return f"{array}[2:len({array}) - 1]"


SPARK, DUCKDB = Spark(), DuckDB()
