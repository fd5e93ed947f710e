"""The 24 signature rules as data, and their compilation to SQL predicates over a text.

A string is (kind, pattern): `=` case-sensitive text, `~` text without case, `/` regular expression, `/i` one without case, `x` bytes anywhere, `x0` bytes at the start (both in hex). A condition is SQL over the strings' names; n(...) counts those that match. `pdf` is the guard of the PDF rules: the first %PDF is within the first 1024 bytes, or there is none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sievework.functions.dialect import Spark


@dataclass(frozen=True)
class Rule:
    number: int
    name: str
    category: str
    severity: str
    strings: dict[str, tuple[str, str]]
    condition: str


_Q = r"[\x27\x22]"
#: Names, categories, severities and patterns. The test string of rule 1 is written in pieces, as file scanners would take this file for what it describes.
RULES = [
    Rule(1, "EICAR_Test_File", "test", "test", {"eicar": ("=", "X5O!P%@AP[4" + chr(92) + "PZX54(P^)7CC)7}$EICAR-" + "STANDARD-ANTIVIRUS-TEST-FILE!$H+H*")}, "eicar"),
    Rule(2, "PHP_Webshell_Input_To_Sink", "webshell", "critical", {"php1": ("~", "<?php"), "php2": ("=", "<?="), "s1": ("/i", r"(eval|assert)\s*\(\s*(\$_(POST|GET|REQUEST|COOKIE|SERVER)|base64_decode|gzinflate|gzuncompress|str_rot13)"), "s2": ("/i", r"(system|shell_exec|passthru|exec|popen|proc_open)\s*\(\s*\$_(POST|GET|REQUEST|COOKIE)"), "s3": ("/", r"\$_(POST|GET|REQUEST|COOKIE)\s*\[[^\]]{0,64}\]\s*\("), "s4": ("/i", r"preg_replace\s*\(\s*" + _Q + r"[^\x27\x22]*/e" + _Q)}, "(php1 or php2) and (s1 or s2 or s3 or s4)"),
    Rule(3, "PHP_Webshell_Obfuscated_Execution", "webshell", "critical", {"php": ("~", "<?php"), "o1": ("/i", r"eval\s*\(\s*(base64_decode|gzinflate|gzuncompress|str_rot13|convert_uudecode|hex2bin)\s*\("), "o2": ("/i", r"assert\s*\(\s*(base64_decode|gzinflate|str_rot13)\s*\("), "o3": ("/i", r"(create_function|call_user_func|call_user_func_array)\s*\(\s*(base64_decode|\$)"), "o4": ("/", r"\$\{\x22GLOBALS\x22\}"), "o5": ("/i", r"(\\x[0-9a-f]{2}){8,}")}, "php and (o1 or o2 or o3 or o4 or o5)"),
    Rule(4, "PHP_Webshell_Known_Signatures", "webshell", "critical", {"php": ("~", "<?php"), "strong1": ("~", "c99shell"), "strong2": ("~", "r57shell"), "strong3": ("~", "b374k"), "strong4": ("~", "FilesMan"), "strong5": ("~", "phpspy"), "strong6": ("/i", r"@eval\s*\(\s*\$_(POST|GET|REQUEST)"), "strong7": ("~", "WSO 2."), "weak1": ("=", "shell_exec"), "weak2": ("~", "safe_mode"), "weak3": ("~", "web shell"), "weak4": ("~", "backdoor"), "weak5": ("=", "uname -a")}, "(strong1 or strong2 or strong3 or strong4 or strong5 or strong6 or strong7) or (php and n(weak1, weak2, weak3, weak4, weak5) >= 3)"),
    Rule(5, "PHP_Code_In_Image_File", "webshell", "critical", {"jpeg": ("x0", "FFD8"), "gif": ("x0", "47494638"), "png": ("x0", "89504E47"), "bmp": ("x0", "424D"), "php1": ("~", "<?php"), "php2": ("=", "<?="), "sink": ("/i", r"\b(eval|system|shell_exec|passthru|assert|base64_decode)\s*\(")}, "(jpeg or gif or png or bmp) and (php1 or php2) and sink"),
    Rule(6, "ASP_Webshell_Execution", "webshell", "critical", {"tag": ("=", "<%"), "a1": ("/i", r"eval\s*\(?\s*request"), "a2": ("/i", r"execute(global)?\s*\(?\s*request"), "a3": ("/i", r"Server\.CreateObject\s*\(\s*\x22WScript\.Shell\x22"), "a4": ("/i", r"Server\.CreateObject\s*\(\s*\x22Shell\.Application\x22"), "a5": ("/i", r"CreateObject\s*\(\s*\x22WScript\.Shell\x22")}, "tag and (a1 or a2 or a3 or a4 or a5)"),
    Rule(7, "ASPX_Webshell_Execution", "webshell", "critical", {"p1": ("~", "<%@ Page"), "p2": ("~", 'runat="server"'), "x1": ("/i", r"Process\.Start\s*\("), "x2": ("~", "System.Diagnostics.Process"), "x3": ("/", r"Request\[[^\]]+\]"), "x4": ("~", "cmd.exe"), "x5": ("~", "System.Reflection.Assembly.Load"), "x6": ("/i", r"eval\s*\(\s*Request")}, "(p1 or p2) and (n(x1, x2, x3, x4, x5) >= 2 or x6)"),
    Rule(8, "JSP_Webshell_Execution", "webshell", "critical", {"tag": ("=", "<%"), "j1": ("~", "Runtime.getRuntime().exec("), "j2": ("~", "ProcessBuilder"), "j3": ("/i", r"request\.getParameter\s*\("), "j4": ("=", "/bin/sh"), "j5": ("~", "cmd.exe")}, "tag and (j1 or j2) and (j3 or j4 or j5)"),
    Rule(9, "PDF_Auto_Executing_JavaScript", "malicious-document", "high", {"js1": ("~", "/JavaScript"), "js2": ("~", "/JS"), "act1": ("~", "/OpenAction"), "act2": ("~", "/AA")}, "pdf and (js1 or js2) and (act1 or act2)"),
    Rule(10, "PDF_Launch_Action", "malicious-document", "high", {"launch": ("~", "/Launch")}, "pdf and launch"),
    Rule(11, "PDF_Embedded_File", "malicious-document", "medium", {"emb": ("~", "/EmbeddedFile"), "ef": ("=", "/EF")}, "pdf and (emb or ef)"),
    Rule(12, "PDF_Obfuscated_Name_Evasion", "evasion", "high", {"js1": ("/i", r"/(J#61|Ja#76|Jav#61|Java#53|JavaS#63|JavaSc#72|JavaScr#69|JavaScri#70|JavaScrip#74)"), "js2": ("/i", r"/J#61vaScript"), "js3": ("/i", r"/(J#53|JS#00)"), "oa": ("/i", r"/(O#70en|Op#65n|Ope#6E|Open#41|OpenA#63|OpenAc#74|OpenAct#69)"), "la": ("/i", r"/(L#61unch|La#75nch|Lau#6Ech|Laun#63h|Launc#68)"), "aa": ("/i", r"/#41A"), "ef": ("/i", r"/(E#6DbeddedFile|Em#62eddedFile|Emb#65ddedFile)")}, "pdf and (js1 or js2 or js3 or oa or la or aa or ef)"),
    Rule(13, "Office_Macro_AutoExec", "malicious-document", "high", {"ole": ("x0", "D0CF11E0A1B11AE1"), "vba": ("=", "vbaProject.bin"), "m1": ("=", "AutoOpen"), "m2": ("=", "Auto_Open"), "m3": ("=", "Document_Open"), "m4": ("=", "Workbook_Open"), "m5": ("=", "AutoExec"), "m6": ("=", "AutoClose")}, "(ole or vba) and (m1 or m2 or m3 or m4 or m5 or m6)"),
    Rule(14, "Office_Macro_Suspicious_Calls", "malicious-document", "high", {"vba": ("=", "Attribute VB_Name"), "c1": ("~", "Shell("), "c2": ("~", "CreateObject("), "c3": ("~", "WScript.Shell"), "c4": ("~", "powershell"), "c5": ("~", "MSXML2.XMLHTTP"), "c6": ("~", "URLDownloadToFile"), "c7": ("~", "ADODB.Stream"), "c8": ("~", "Environ("), "c9": ("~", "GetObject(")}, "vba and n(c1, c2, c3, c4, c5, c6, c7, c8, c9) >= 2"),
    Rule(15, "Office_DDE_AutoExec", "malicious-document", "high", {"d1": ("~", "DDEAUTO"), "d2": ("/i", r"!\s*DDE")}, "d1 or d2"),
    Rule(16, "Script_Or_Handler_Embedded", "script-injection", "medium", {"s1": ("~", "<script"), "s2": ("/i", r"on(load|error|click|mouseover)\s*="), "s3": ("~", "javascript:"), "s4": ("~", "<iframe"), "s5": ("/i", r"document\.write\s*\("), "s6": ("/i", r"eval\s*\(")}, "(s1 and (s2 or s3 or s5 or s6)) or n(s1, s2, s3, s4, s5, s6) >= 3"),
    Rule(17, "SVG_With_Active_Content", "script-injection", "high", {"svg": ("~", "<svg"), "s1": ("~", "<script"), "s2": ("/i", r"on(load|click|mouseover|error)\s*="), "s3": ("~", "foreignObject"), "s4": ("~", "javascript:"), "s5": ("~", "<!ENTITY")}, "svg and (s1 or s2 or s3 or s4 or s5)"),
    Rule(18, "XML_External_Entity_XXE", "xxe", "high", {"doc": ("~", "<!DOCTYPE"), "ent": ("~", "<!ENTITY"), "sys": ("=", "SYSTEM"), "pub": ("=", "PUBLIC"), "file": ("~", "file://"), "php": ("~", "php://")}, "doc and ent and (sys or pub or file or php)"),
    Rule(19, "Embedded_Windows_Executable", "embedded-executable", "critical", {"mz": ("x", "4D5A"), "pe": ("x", "50450000"), "first": ("x0", "4D5A")}, "pe and mz and not first"),
    Rule(20, "Embedded_ELF_Executable", "embedded-executable", "critical", {"elf": ("x", "7F454C46"), "first": ("x0", "7F454C46")}, "elf and not first"),
    Rule(21, "PDF_Encrypted_Unscannable", "evasion", "medium", {"enc": ("=", "/Encrypt")}, "pdf and enc"),
    Rule(22, "Archive_Embedded_In_Image", "polyglot", "critical", {"jpeg": ("x0", "FFD8FF"), "png": ("x0", "89504E470D0A1A0A"), "riff": ("x0", "52494646"), "zip": ("x", "504B0304"), "zip_ed": ("x", "504B0506"), "rar4": ("x", "526172211A0700"), "rar5": ("x", "526172211A070100"), "sevenz": ("x", "377ABCAF271C"), "cab": ("x", "4D53434600000000")}, "(jpeg or png or riff) and (zip or zip_ed or rar4 or rar5 or sevenz or cab)"),
    Rule(23, "PDF_Name_Tree_JavaScript", "malicious-document", "high", {"names": ("~", "/Names"), "js": ("~", "/JavaScript")}, "pdf and names and js"),
    Rule(24, "PDF_Page_Covering_Link", "phishing", "high", {"link": ("~", "/Subtype/Link"), "uri": ("~", "/URI"), "wide": ("/", r"/Rect\s*\[\s*-?[\d.]{1,8}\s+-?[\d.]{1,8}\s+[1-9]\d{3,}(\.\d+)?\s")}, "pdf and link and uri and wide"),
]


def string_sql(d: Spark, kind: str, pattern: str, t: str, low: str, raw: str) -> str:
    """Whether a string occurs. t: the text (of bytes, one character a byte), low: the same in lower case, raw: the content (Spark: bytes; DuckDB: their hex)."""
    if kind == "=":
        return f"contains({t}, {d.text(pattern)})"
    if kind == "~":
        return f"contains({low}, {d.text(pattern.lower())})"
    if kind in ("/", "/i"):
        return d.rx(t, pattern, kind == "/i")
    if d.name == "spark":
        return f"contains({raw}, X'{pattern}')" if kind == "x" else f"startswith({raw}, X'{pattern}')"
    return f"regexp_matches({raw}, '^(..)*{pattern}')" if kind == "x" else f"starts_with({raw}, '{pattern}')"


def rule_sql(rule: Rule, d: Spark, t: str = "t", low: str = "low", raw: str = "raw", gated: bool = False) -> str:
    """The rule's predicate; gated: with regular expressions behind their anchors."""
    one = {k: _gated(rule, k, t, low, raw, d) if gated else string_sql(d, kind, p, t, low, raw) for k, (kind, p) in rule.strings.items()}
    one["pdf"] = f"(contains(left({t}, 1028), '%PDF') OR NOT contains({t}, '%PDF'))" if d.name == "spark" else f"(strpos({t}, '%PDF') <= 1025)"
    text = re.sub(r"n\(([^)]*)\)", lambda m: "(" + " + ".join(f"CASE WHEN {x.strip()} THEN 1 ELSE 0 END" for x in m[1].split(",")) + ")", rule.condition)
    return "(" + re.sub(r"\b[a-z]\w*\b", lambda m: one.get(m[0], m[0]), text) + ")"


#: For each regular expression texts in lower case one of which every match holds.
ANCHORS = {
    (2, "s1"): ["eval", "assert"], (2, "s2"): ["$_"], (2, "s3"): ["$_"], (2, "s4"): ["preg_replace"],
    (3, "o1"): ["eval"], (3, "o2"): ["assert"], (3, "o3"): ["create_function", "call_user_func"], (3, "o4"): ["${"], (3, "o5"): ["\\x"],
    (4, "strong6"): ["@eval"], (5, "sink"): ["eval", "system", "shell_exec", "passthru", "assert", "base64_decode"],
    (6, "a1"): ["eval"], (6, "a2"): ["execute"], (6, "a3"): ["createobject"], (6, "a4"): ["createobject"], (6, "a5"): ["createobject"],
    (7, "x1"): ["process.start"], (7, "x3"): ["request["], (7, "x6"): ["eval"], (8, "j3"): ["request.getparameter"],
    (12, "js1"): ["/j#", "/ja#", "/jav#", "/java#", "/javas#", "/javasc#", "/javascr#", "/javascri#", "/javascrip#"], (12, "js2"): ["/j#"], (12, "js3"): ["/j#", "/js#"],
    (12, "oa"): ["/o#", "/op#", "/ope#", "/open#", "/opena#", "/openac#", "/openact#"], (12, "la"): ["/l#", "/la#", "/lau#", "/laun#", "/launc#"], (12, "aa"): ["/#41"], (12, "ef"): ["/e#", "/em#", "/emb#"],
    (15, "d2"): ["dde"], (16, "s2"): ["onload", "onerror", "onclick", "onmouseover"], (16, "s5"): ["document.write"], (16, "s6"): ["eval"], (17, "s2"): ["onload", "onerror", "onclick", "onmouseover"], (24, "wide"): ["/rect"],
}
def anchors_of(rule: Rule, name: str) -> list[str]:
    """Texts in lower case (a character a byte) one of which every match of the string holds; none for a string that stands at the start alone."""
    kind, pattern = rule.strings[name]
    return {"=": lambda: [pattern.lower()], "~": lambda: [pattern.lower()], "x": lambda: [bytes.fromhex(pattern).decode("latin-1").lower()], "x0": list}.get(kind, lambda: ANCHORS[rule.number, name])()


def _gated(rule: Rule, name: str, t: str, low: str, raw: str, d: Spark) -> str:
    """Whether a string occurs; a regular expression is looked for only in texts that hold one of its anchors."""
    kind, pattern = rule.strings[name]
    exact = string_sql(d, kind, pattern, t, low, raw)
    return f"(({' OR '.join(f'contains({low}, {d.text(a)})' for a in anchors_of(rule, name))}) AND {exact})" if kind[0] == "/" else exact


def matched_sql(d: Spark, t: str = "t", low: str = "low", raw: str = "raw") -> str:
    """An array of the numbers of the rules that match, in order. Spark runs a regular expression only where one of its anchors was found and the rule still depends on it."""
    items = ", ".join(f"CASE WHEN {rule_sql(r, d, t, low, raw, gated=d.name == 'spark')} THEN {r.number} END" for r in RULES)
    return d.kept(d.array(items), "x", "x IS NOT NULL")
