"""Rule cases: for each rule a text that matches and one that just doesn't."""

from __future__ import annotations

from sievework.functions.dialect import Spark
from sievework.functions.rules import RULES

_EICAR = RULES[0].strings["eicar"][1]
#: (rule, matches, SQL of the text)
CASES = [
    (1, True, lambda d: d.text(_EICAR)),
    (1, False, lambda d: d.text(_EICAR[:-1])),
    (2, True, lambda d: "'<?= eval($_POST[1])'"),
    (2, False, lambda d: "'eval($_POST[1])'"),
    (3, True, lambda d: "'<?PHP assert(gzinflate(x'"),
    (3, False, lambda d: "'assert(gzinflate(x'"),
    (4, True, lambda d: "'<?php shell_exec safe_mode backdoor'"),
    (4, False, lambda d: "'<?php shell_exec safe_mode'"),
    (4, False, lambda d: "'<?php SHELL_EXEC safe_mode UNAME -A'"),
    (5, True, lambda d: "'BM<?php passthru ('"),
    (5, False, lambda d: "'xBM<?php passthru ('"),
    (6, True, lambda d: "'<% execute(request'"),
    (6, False, lambda d: "'% execute(request'"),
    (7, True, lambda d: "'<%@ page cmd.exe Request[a]'"),
    (7, False, lambda d: "'<%@ page cmd.exe'"),
    (8, True, lambda d: "'<% ProcessBuilder /bin/sh'"),
    (8, False, lambda d: "'<% ProcessBuilder'"),
    (9, True, lambda d: "'/JS /AA'"),
    (9, False, lambda d: "repeat(' ', 1025) || '%PDF /JS /AA'"),
    (10, True, lambda d: "'%PDF /launch'"),
    (10, False, lambda d: "repeat(' ', 1025) || '%PDF /launch'"),
    (11, True, lambda d: "'%PDF /EF '"),
    (11, False, lambda d: "'%PDF /ef '"),
    (12, True, lambda d: "'%PDF /OpenA#63tion'"),
    (12, False, lambda d: "'%PDF /OpenAction'"),
    (13, True, lambda d: "'vbaProject.bin AutoOpen'"),
    (13, False, lambda d: "'vbaProject.bin autoopen'"),
    (14, True, lambda d: "'Attribute VB_Name SHELL( environ('"),
    (14, False, lambda d: "'Attribute VB_Name SHELL('"),
    (15, True, lambda d: "'=! dde'"),
    (15, False, lambda d: "'=!x dde'"),
    (16, True, lambda d: "'<iframe javascript: eval ('"),
    (16, False, lambda d: "'<iframe javascript:'"),
    (17, True, lambda d: "'<SVG foreignobject'"),
    (17, False, lambda d: "'<SVG foreign'"),
    (18, True, lambda d: "'<!doctype <!entity PUBLIC'"),
    (18, False, lambda d: "'<!doctype <!entity public'"),
    (19, True, lambda d: "'x MZ PE' || chr(0) || chr(0)"),
    (19, False, lambda d: "'MZ PE' || chr(0) || chr(0)"),
    (20, True, lambda d: "'x' || chr(127) || 'ELF'"),
    (20, False, lambda d: "chr(127) || 'ELF'"),
    (21, True, lambda d: "'%PDF /Encrypt'"),
    (21, False, lambda d: "'%PDF /encrypt'"),
    (22, True, lambda d: "'RIFF PK' || chr(3) || chr(4)"),
    (22, False, lambda d: "'xRIFF PK' || chr(3) || chr(4)"),
    (23, True, lambda d: "'%PDF /names /javascript'"),
    (23, False, lambda d: "'%PDF /names'"),
    (24, True, lambda d: "'%PDF /Subtype/Link /URI /Rect [0 0 1200 800 ]'"),
    (24, False, lambda d: "'%PDF /Subtype/Link /URI /Rect [0 0 120 800 ]'"),
]


def cases_sql(d: Spark) -> str:
    """The cases as submissions with negative ids."""
    rows = ", ".join(f"(cast({-k - 1} as bigint), {rule}, {str(ok).lower()}, {text(d)})" for k, (rule, ok, text) in enumerate(CASES))
    return f"SELECT id, cast(NULL as string) AS truth, 'id' AS category, 'application/pdf' AS declared_type, 'case.pdf' AS file_name, payload, rule_no, is_positive FROM (VALUES {rows}) AS c(id, rule_no, is_positive, payload)"
