"""Credentials embedded in source code, configuration and prose: find them and mask exactly them.

Configuration (JSON, YAML, INI, environment files, properties, TOML) is parsed into settings: the whole key path of
every value with its offsets. A setting is a hit if its path names a secret and the value has the shape of one: no
placeholder, reference, prompt, label or limit. A path names a secret by its last part, or by the part above if the
last only says that this is the value. Markup, code and prose come down to assignments of the same kind, read line by
line. Values of a known token shape, logins inside addresses, headers and commands, and private keys are hits under
any key. Masks are spliced into the original text from the last span to the first, so everything else stays where it was.

Defined results: null and empty texts have no hit and come back unchanged; overlapping spans are merged; a value
cut off by the end of the text counts as far as it goes; a value in pieces is listed at its first piece and every
piece is masked; repeated rows give repeated results; very long lines are read whole, by linear scans; a text without
a path, or with a null one, is taken for configuration if it has the shape of it.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import configs

MASK = "[MASKED]"

#: Last words of a key that name a secret, and last pairs and triples.
SECRET_WORDS = {"password", "passwd", "pwd", "passphrase", "pass", "pw", "passcode", "secret", "token", "bearer", "apikey", "authtoken",
                "accesstoken", "secretkey", "privatekey", "signingkey", "accesskey", "userpass", "userpassword", "dbpassword", "dbpass", "psk", "credential", "credentials"}
SECRET_PAIRS = {("api", "key"), ("access", "key"), ("secret", "key"), ("signing", "key"), ("private", "key"), ("encryption", "key"), ("auth", "key"),
                ("master", "key"), ("shared", "key"), ("account", "key"), ("service", "key"), ("license", "key"), ("key", "pem"), ("key", "id"), ("app", "key"),
                ("client", "key"), ("session", "key"), ("ssh", "key"), ("deploy", "key"), ("storage", "key"), ("hmac", "key"), ("jwt", "key")}
WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A line with none of these, in any case, is not read at all.
LITERALS = ("pass", "pwd", "pw", "secret", "token", "key", "bearer", "authori", "auth", "login", "log in", "sign", "connect", "logon", "bind", "credential", "psk", "://",
            "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_", "rk_", "whsec_", "eyj", "aiza", "npm_", "hf_", "pypi-",
            "dop_v1", "sg.", "shpat_", "shpss_", "shpca_", "shppa_", "curl", "wget", "mysql", "maria", "redis-cli", "ftp", "identified", "pdo")
#: A line must also match this: a secret's name at the end of an identifier, or the start of one of the other forms.
QUICK = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|key(?:[-_]?(?:pem|id))?|bearer|psk|auth|log[-_ ]?in|sign[-_ ]?in|logon|connect|authenticate|bind|credentials?)(?:_?\d+)?(?![a-z0-9_])"
                   r"|authori[sz]ation|://[^\s/@:]*:[^\s/@]+@|akia|asia|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|\b[sr]k[-_]|whsec_|eyj|aiza|npm_|hf_|pypi-|dop_v1|sg\.|shp(?:at|ss|ca|pa)_|\b(?:curl|wget)\s|\b(?:mysql|maria)|redis-cli|ftp\s|identified|\bpdo\b")
FOUR_BY_FOUR = re.compile(r"(?<![\w-])[a-z]{4}-[a-z]{4}-[a-z]{4}-[a-z]{4}(?![\w-])")
KEY = r"(?P<key>[A-Za-z_@$][\w.\-]*|[A-Za-z_]\w*(?:\[\s*['\"][\w.\-]+['\"]\s*\])+)"
STR = r"""(?:"(?P<dq>(?:[^"\\\n]|\\.)*)(?:"|$|(?=\n))|'(?P<sq>(?:[^'\\\n]|\\.)*)(?:'|$|(?=\n))|`(?P<bq>[^`\n]*)(?:`|$|(?=\n)))"""
#: key, an optional type, an operator, a value: quoted with an optional prefix, or bare.
SETTING = re.compile(
    r"(?<!\$\{)(?<![\w$@.\-/])" + KEY + r"['\"`]?\s*\]?\s*(?::\s*(?:Optional\[)?(?:str|string|String|bytes|any|text|Final|const|char\s*\*|&str|&'static str)\]?(?:\s*\|\s*\w+)?\s*=|=>|:=|\?=|<-|->|={1}(?!=)|:(?!:|//)|\s(?:is|was)(?=\s+[`'\"]?[^\s`'\"]*\d))[ \t]*(?P<pre>[rbuf]{1,2}(?=['\"]))?"
    r"(?:" + STR + r"|(?P<bare>[^\s'\"`<>|,;()\[\]{}][^\s'\"`,;<>]*))?", re.M)
DEFINE = re.compile(r"\b(?:define|setenv|putenv|set|setProperty|put|config|env)\s*\(\s*['\"](?P<key>[\w.\-]+)['\"]\s*,\s*" + STR)
FIELD_NAME_ATTR = re.compile(r"\b(?:name|id|key)\s*=\s*['\"](?P<key>[\w.\-]+)['\"]")
FIELD_VALUE_ATTR = re.compile(r"\bvalue\s*=\s*" + STR)
TAG_EDGE = re.compile(r"[<>]")
ELEMENT = re.compile(r"<(?P<key>[A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>(?P<bare>[^<>\s][^<>\n]*)</(?P=key)>")
FALLBACK = re.compile(r"(?:process\.env\.(?P<k1>\w+)|(?:getenv|environ\.get|env|ENV\.fetch|System\.getenv|os\.Getenv|getOrDefault)\s*\(\s*['\"](?P<k2>\w+)['\"]\s*\)?|\$_ENV\[\s*['\"](?P<k3>\w+)['\"]\s*\]|environ\[\s*['\"](?P<k4>\w+)['\"]\s*\])[!)]*\s*(?:\|\||\?\?|\?:|,|\bor\b)\s*" + STR)
SHELL_DEFAULT = re.compile(r"\$\{(?P<key>\w+):?[-=](?P<bare>[^}\s'\"$]+)\}?")
LOGIN_PAIR = re.compile(r"(?<![\w.\-])['\"]?(?P<key>auth|login|credentials|basic_auth|httpAuth|http_auth)['\"]?\s*(?:=>|=|:)\s*(?:[\[({]|new \w+\()\s*['\"]?[\w.@\-]+['\"]?\s*,\s*(?:" + STR + r"|(?P<bare>[^\s'\"`,\])}]+))")
URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,30}://(?P<user>[^\s:/@'\"<>`]*):(?P<bare>[^\s/@'\"<>`]+)@(?=[\w\[$.\-])")
HEADER = re.compile(r"(?i)\b(?:proxy-)?authori[sz]ation['\"]?\s*(?::|=>|=|,)\s*['\"]?\s*(?P<kind>bearer|basic|token|apikey|digest)\s+(?P<bare>[^\s'\"`,;<>)\]}]+)")
#: Literals one of which a line must hold, and the form.
COMMANDS = (
    (("sshpass",), re.compile(r"\bsshpass\s+-p\s*(?:" + STR + r"|(?P<bare>[^\s'\"]+))")),
    (("mysql", "maria"), re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|mysqlimport|mysqlshow)\b(?:(?!\b(?:mysql|mysqldump|mysqladmin|mariadb|mysqlimport|mysqlshow)\b)[^\n|;])*?\s-p(?:" + STR + r"|(?P<bare>[^\s'\"]+))")),
    (("curl", "wget", "http"), re.compile(r"\b(?:curl|wget|http|https)\b(?:(?!\b(?:curl|wget|http|https)\b)[^\n|;])*?\s(?:-u|--user|--proxy-user|-U)[ =]?\s*['\"]?[^\s:'\"]+:(?:" + STR + r"|(?P<bare>[^\s'\"]+))")),
    ((" -",), re.compile(r"\s--?(?:[\w\-]+-)?(?:password|passwd|pass|token|secret|api-key|access-key|secret-key|apikey|passphrase|pw)(?:=|\s+)(?:" + STR + r"|(?P<bare>[^\s'\"\-][^\s'\"]*))")),
    (("redis-cli",), re.compile(r"\b(?:redis-cli)\b(?:(?!\b(?:redis-cli)\b)[^\n|;])*?\s-a\s+(?:" + STR + r"|(?P<bare>[^\s'\"]+))")),
    (("docker", "podman", "helm", "az ", "smbclient", "ldapsearch", "psql", "PGPASSWORD"), re.compile(r"\b(?:docker|podman|helm|az|smbclient|ldapsearch|psql|PGPASSWORD)\b(?:(?!\b(?:docker|podman|helm|az|smbclient|ldapsearch|psql|PGPASSWORD)\b)[^\n|;])*?\s-(?:p|w)\s+(?:" + STR + r"|(?P<bare>[^\s'\"\-][^\s'\"]*))")),
    (("ftp", "smbclient", "rclone"), re.compile(r"\b(?:lftp|ncftp|smbclient|rclone|sftp|ftp)\b(?:(?!\b(?:lftp|ncftp|smbclient|rclone|sftp|ftp)\b)[^\n|;])*?\s(?:-u|-U|--user)[ =]?\s*['\"]?[^\s,:%'\"]+[,:%](?:" + STR + r"|(?P<bare>[^\s'\"]+))")),
    (("(",), re.compile(r"\b(?:login|log_in|connect|authenticate|auth|signin|sign_in|logon|bind|simple_bind|set_credentials|setCredentials|basicAuth|basic_auth)\s*\(\s*['\"][\w.@\-]+['\"]\s*,\s*" + STR)),
    ((" with ", " using ", " and "), re.compile(r"(?i)\b(?:log ?in|sign ?in|connect|authenticate)\s+(?:as|with user)\s+\S+\s+(?:with|using|and)\s+(?:the\s+)?(?:password\s+)?(?:" + STR + r"|(?P<bare>[^\s'\"`,;<>()]+))")),
    (("machine",), re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<bare>\S+)")),
    (("new ",), re.compile(r"\bnew\s+\\?(?:PDO|mysqli)\s*\(\s*['\"][^'\"\n]*['\"]\s*,\s*['\"][^'\"\n]*['\"]\s*,\s*" + STR)),
    ((" is ", " was ", " = ", " : "), re.compile(r"(?i)\b(?:password|passphrase|passcode|token|secret|login|api[ _-]?key)\s+(?:is|was|=|:)\s+(?:" + STR + r"|(?P<bare>[^\s'\"`,;<>()]+))")),
    (("dentified", "DENTIFIED"), re.compile(r"(?i)\bIDENTIFIED\s+(?:WITH\s+\w+\s+)?BY\s+" + STR)),
)
#: Token shapes that are credentials under any key.
SHAPES = re.compile(
    r"(?<![A-Za-z0-9_/+\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9/+=])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|sk-(?:ant-|proj-|svcacct-)?[A-Za-z0-9_\-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{16,}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}"
    r"|pypi-[A-Za-z0-9_\-]{30,}|dop_v1_[a-f0-9]{40,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{24,})")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"(?:[ \t\r\n]|\\[rn]|(?:#|//|--|\*|;)[ \t]*(?=[A-Za-z0-9+/=]{16})|[\"'+.,]|[A-Za-z0-9+/=]{4,}|(?:Proc-Type|DEK-Info|Comment|Version): [^\n]*)*")
CONTINUED = re.compile(r"[ \t]*(?:\\|\+|\.|&|)[ \t]*\r?\n[ \t]*(?:(?:#|//|--|\*)[ \t]*)?(?:\+|\.|&)?[ \t]*" + STR)
SAME_LINE = re.compile(r"[ \t]*(?:\+|\.|&)[ \t]*" + STR)
EMBEDDED = re.compile(r"data:[\w.+\-]+/[\w.+\-]+;base64,[A-Za-z0-9+/=]+")

PLACEHOLDER = re.compile(
    r"(?i)x{8,}|\*{3,}|0{8,}|1234567|\.{3,}|•{2,}|_{4,}|-{6,}|#{4,}|\?{3,}|<[^<>]*>|(?<![a-z0-9])your(?![a-z0-9])|goes[_-]here|[_-]here\b|replace[_-]?|change[_-]?(?:me|it|this)\b|redacted|placeholder|censored|scrubbed|not[_-]?a[_-]?(?:real|secret)|insert[_-]|fill[_-]in|set[_-]in|set[_-]me|secret[_-]?manager"
    r"|(?<![a-z0-9])(?:masked|removed|hidden|todo|fixme|tbd|example|sample|dummy|fake|vault|keyring|unset|changeme)(?![a-z0-9])"
    r"|^(?:none|null|nil|undefined|true|false|empty|not[_-]?set|unused|n/?a|password|passwd|secret|token|pass|pw|pwd|admin|user|root|test|bearer|basic|string|str|bytes|int|text|char|any|object|required|optional|hash|hashed|missing|foo|bar|default|env|prompt|ask|stdin|auto|key|value|yes|no|on|off)$")
RUN_OF_X = re.compile(r"(?i)x{4,}")
APP_PASSWORD = re.compile(r"[a-z]{4}(?:-[a-z]{4}){3}")
REFERENCE = re.compile(r"^\s*(?:\$|%[\w(]|\{\{|\{%|\$\{|#\{|@\{|!|&|\*\w|<%|\{[\w.]+\}|ENC\[|arn:|file:|ref:|op://|env:|vault:|ssm:|kms:|secretref|projects/|process\.env|os\.environ|getenv|env\(|this\.|self\.|req\.|cfg\.|config\.|settings\.|args\.|options\.|props\.|params\.)|\$\{?\w+\}?$|\$\(|\{\{")
CALL = re.compile(r"^[A-Za-z_$][\w$.:>\-]*(?:\(|\[)|^new\s|^await\s|^(?:str|int|bool|float|number|string|boolean|any|object)$")
IDENT = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*[!?]*$")
FIELD_NAME = re.compile(r"(?i)^(?:x-)?[a-z]+(?:[-_ .][a-z]+)*$")


def words(key: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(key)]


def sensitive(path: str) -> bool:
    """Whether a key path names a secret; what counts is its last part."""
    w = words(path)
    if not w:
        return False
    while len(w) > 1 and w[-1].isdigit():
        w.pop()
    if w[-1] in SECRET_WORDS or tuple(w[-2:]) in SECRET_PAIRS and w[-2:] != ["key", "id"]:
        return not (w[-1] == "credential" and len(w) == 1)
    return w[-3:] == ["access", "key", "id"] or w[-2:] == ["keyid", "id"] or "".join(w[-2:]) in SECRET_WORDS and len(w) > 1


#: Last parts of a path that only say that here the value stands.
HOLDERS = frozenset(("value", "val", "default", "current", "data", "text", "string", "content", "plain", "plaintext", "raw", "literal"))


def names_secret(path: tuple[str, ...]) -> bool:
    """Whether a whole key path names a secret: by its last part, or by the one above parts that only hold the value."""
    parts = [x for k in path for x in re.split(r"[./]", k) if x]
    while len(parts) > 1 and parts[-1].lower() in HOLDERS:
        parts.pop()
    return bool(parts) and sensitive(parts[-1])


def placeholder(v: str) -> bool:
    """Whether a value only stands in for one."""
    return bool(PLACEHOLDER.search(v)) or bool(RUN_OF_X.search(v)) and sum(c in "xX" for c in v) > 0.4 * len(v)


def usable(value: str, quoted: bool, code: bool = False) -> bool:
    """Whether a value could open something: no placeholder, reference, label, name, prompt or limit."""
    v = value.strip()
    if len(v) < 6 or placeholder(v) or REFERENCE.search(v):
        return False
    if re.search(r"\s", v):
        return False
    if v.replace(".", "").replace(",", "").isdigit() and len(v) < 8:
        return False
    if len(set(v)) < 4:
        return False
    if not quoted and (CALL.match(v) or IDENT.match(v) and not re.search(r"\d", v)):
        return False
    if re.match(r"(?:https?|ftp|file|s3|gs)://|[A-Za-z]:\\|(?:~|\.{0,2})/(?:[a-z0-9_.\-]+/?)*$|(?:~|\.{0,2})/.*\.[a-z]{2,5}$", v) or re.match(r"^[a-z0-9_\-]+(?:/[a-z0-9_\-]+)+$", v) and not re.search(r"\d{2}", v):
        return False
    if re.match(r"^sha(?:1|256|384|512)[-:]", v):
        return False
    if FIELD_NAME.match(v) and not APP_PASSWORD.fullmatch(v):
        # letters only: a name, unless the letters look drawn
        low = v.lower()
        if re.search(r"[-_ .]", v) or len(v) < 12 or v.islower() or v.istitle():
            return False
        if any(x in low for x in ("password", "token", "secret", "key", "auth", "bearer")):
            return False
        return bool(re.search(r"[a-z][A-Z]", v)) and len(set(v)) >= 8 and not re.fullmatch(r"(?:[A-Z]?[a-z]{3,})+", v)
    if re.fullmatch(r"[A-Z]+(?:_[A-Z]+)*", v) and len(v) < 40:
        return False
    return True


def app_password(value: str) -> bool:
    """Four different groups of four letters, as mail services give them out."""
    v = value.strip()
    return bool(APP_PASSWORD.fullmatch(v)) and len(set(v.split("-"))) == 4


def shaped(value: str) -> bool:
    """Whether a value of a known token shape is real rather than a placeholder."""
    return not placeholder(value) and len(set(value[4:])) >= 6


def _value(m: re.Match) -> tuple[int, int, bool] | None:
    """Offsets of a match's value and whether it was quoted."""
    g = m.groupdict()
    for name in ("dq", "sq", "bq"):
        if g.get(name) is not None:
            return *m.span(name), True
    if g.get("bare") is not None:
        return *m.span("bare"), False
    return None


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The piece of a quoted value at [start, end) and those joined to it by an operator, on this line or the next ones."""
    out, at = [(start, end)], end + 1
    while True:
        m = SAME_LINE.match(text, at) or CONTINUED.match(text, at)
        if not m:
            return out
        a, b, _ = _value(m)
        if re.match(r"\s*(?::|=>|=)", text[b + 1:b + 8]):
            return out
        out.append((a, b))
        at = b + 1
    return out


NEXT_LINE = re.compile(r"[ \t]*(?:[\\(]|[|>][+-]?)?[ \t]*\r?\n[ \t]+(?:(?:#|//|--)[ \t]*)?(?:" + STR + r"|(?P<bare>[^\s'\"`:=]+)[ \t]*\r?(?=\n|$))")


class _Reader:
    """One text's spans: those of its settings, if it is configuration, then line by line."""

    def __init__(self, text: str, path: str | None = None):
        self.text = text
        self.hits: dict[int, list[tuple[int, int]]] = {}
        self.parsed: set[int] = set()  # where values of parsed settings begin
        self.blind = [m.span() for m in EMBEDDED.finditer(text)] if ";base64," in text else []
        if "PRIVATE KEY" in text:
            self.keys()
        if form := configs.form_of(text, path):
            self.configuration(form)

    def configuration(self, form: str) -> None:
        for keys, a, b, quoted in configs.settings(self.text, form):
            self.parsed.add(a)
            if names_secret(keys) or app_password(self.text[a:b]):
                self.offer((a, b, quoted))

    def add(self, parts: list[tuple[int, int]]) -> None:
        if parts[0][0] not in self.hits or parts[-1][1] > self.hits[parts[0][0]][-1][1]:
            self.hits[parts[0][0]] = parts

    def keys(self) -> None:
        """Private keys, from BEGIN to END or as far as the body goes."""
        text = self.text
        for m in PEM.finditer(text):
            e = PEM_END.search(text, m.end())
            body = PEM_BODY.match(text, m.end()).end()
            closed = e is not None and e.start() <= body + 4
            end = e.end() if closed else body
            inner = re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", text[m.end():e.start() if closed else body])
            if len(inner) < 16 and (closed or end < len(text) - 2) or len(set(inner)) < 8 and len(inner) >= 16:
                continue
            self.blind.append((m.start(), end))
            self.add([(m.start(), end)])

    def covered(self, at: int) -> bool:
        return any(a <= at < b for a, b in self.blind)

    def offer(self, v: tuple[int, int, bool], fits=usable) -> None:
        a, b, quoted = v
        text = self.text
        if b <= a or self.covered(a):
            return
        parts = _pieces(text, a, b) if quoted and b < len(text) and text[b] in "\"'`" else [(a, b)]
        whole = "".join(text[x:y] for x, y in parts)
        if "PRIVATE KEY" not in whole and "-----BEGIN" not in whole and fits(whole, quoted):
            self.add(parts)

    def line(self, lo: int, hi: int) -> None:
        text = self.text
        s = text[lo:hi]
        for m in SHAPES.finditer(text, lo, hi):
            if not self.covered(m.start()) and shaped(m.group()):
                self.add([m.span()])
        if "://" in s:
            for m in URL.finditer(text, lo, hi):
                v = m.group("bare")
                if not self.covered(m.start()) and not REFERENCE.search(v) and not placeholder(v) and (len(v) >= 6 or len(v) >= 4 and re.search(r"\d", v)):
                    self.add([m.span("bare")])
        for m in HEADER.finditer(text, lo, hi) if "uthori" in s or "UTHORI" in s else ():
            v, kind = m.group("bare"), m.group("kind").lower()
            if self.covered(m.start()) or REFERENCE.search(v) or placeholder(v):
                continue
            if kind == "basic":
                try:
                    plain = base64.b64decode(v + "=" * (-len(v) % 4)).decode("utf-8")
                    if ":" not in plain or placeholder(plain.split(":", 1)[1]):
                        continue
                except (binascii.Error, ValueError):
                    if len(v) < 12:
                        continue
                self.add([m.span("bare")])
            elif usable(v, True):
                self.add([m.span("bare")])
        for literals, pattern in COMMANDS:
            if any(x in s for x in literals):
                for m in pattern.finditer(text, lo, hi):
                    if v := _value(m):
                        self.offer(v, lambda x, q: usable(x, True))
        if "," in s:
            for m in LOGIN_PAIR.finditer(text, lo, hi):
                if v := _value(m):
                    self.offer(v, lambda x, q: usable(x, True))
        for m in FALLBACK.finditer(text, lo, hi) if "env" in s.lower() else ():
            if sensitive(m.group("k1") or m.group("k2") or m.group("k3") or m.group("k4")) and (v := _value(m)):
                self.offer(v)
        for m in SHELL_DEFAULT.finditer(text, lo, hi) if "${" in s else ():
            if sensitive(m.group("key")):
                self.offer(_value(m), lambda x, q: usable(x, True))
        for literal, pattern in (("(", DEFINE), ("</", ELEMENT)):
            for m in pattern.finditer(text, lo, hi) if literal in s else ():
                if (v := _value(m)) and (sensitive(m.group("key")) or APP_PASSWORD.fullmatch(text[v[0]:v[1]])):
                    self.offer(v, lambda x, q: usable(x, True))
        if "value" in s:
            self.fields(lo, hi)
        self.settings(lo, hi)

    def fields(self, lo: int, hi: int) -> None:
        """Attributes that name a field, with the next value in the same tag."""
        text = self.text
        values = [m for m in FIELD_VALUE_ATTR.finditer(text, lo, hi)]
        starts, edges = [m.start() for m in values], [m.start() for m in TAG_EDGE.finditer(text, lo, hi)]
        for m in FIELD_NAME_ATTR.finditer(text, lo, hi) if values else ():
            i = bisect_left(starts, m.end())
            if i < len(starts) and bisect_left(edges, m.end()) == bisect_left(edges, starts[i]):
                v = _value(values[i])
                if v and (sensitive(m.group("key")) or APP_PASSWORD.fullmatch(text[v[0]:v[1]])):
                    self.offer(v, lambda x, q: usable(x, True))

    def settings(self, lo: int, hi: int) -> None:
        text, at = self.text, lo
        while m := SETTING.search(text, at, hi):
            at = m.end("key") + 1
            v = _value(m)
            if not sensitive(m.group("key")):
                if v and v[0] not in self.parsed and app_password(text[v[0]:v[1]]):
                    self.offer(v)
                continue
            if v and v[0] in self.parsed:
                continue
            if v is None:  # the value stands on the next line
                if (n := NEXT_LINE.match(text, m.end())) and (v := _value(n)):
                    self.offer(v)
            elif v[2]:
                self.offer(v)
            else:
                a, b, _ = v
                s = text[a:b]
                s = s.rstrip("\\.") if not s.rstrip("\\.").endswith("=") else s
                if s.endswith(("*/", "-->")):
                    s = s[:-2].rstrip("-")
                s = s.rstrip(")]}") if not ("(" in s or "[" in s or "{" in s) else s
                if text[b:b + 1] != "(":
                    self.offer((a, a + len(s), False))


def find(text: str | None, path: str | None = None) -> list[list[tuple[int, int]]]:
    """The usable credentials of a text in order, each a list of spans (its pieces). path: the file's, which tells its format."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts = {m.start() for m in FOUR_BY_FOUR.finditer(text)} if text.count("-") > 2 else set()
    for x in LITERALS:
        at = low.find(x)
        while at >= 0:
            starts.add(at)
            at = low.find("\n", at)
            at = low.find(x, at) if at >= 0 else -1
    reader, done = _Reader(text, path) if starts else None, -1
    for at in sorted(starts):
        if at < done:
            continue
        lo, hi = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        hi = done = len(text) if hi < 0 else hi
        if QUICK.search(text, lo, hi) or FOUR_BY_FOUR.search(text, lo, hi):
            reader.line(lo, hi)
    if reader is None:
        if "PRIVATE KEY" not in text:
            return []
        reader = _Reader(text, path)
    out: list[list[tuple[int, int]]] = []
    end = -1
    for start in sorted(reader.hits):
        parts = reader.hits[start]
        if start < end:  # inside the one before
            continue
        out.append(parts)
        end = parts[-1][1]
    return out


def mask(text: str | None, path: str | None = None) -> str | None:
    """The text with every piece of every credential replaced by MASK and everything else as it was."""
    if not text:
        return text
    hits = find(text, path)
    for a, b in sorted((s for parts in hits for s in parts), reverse=True):
        text = text[:a] + MASK + text[b:]
    return text


def scan(df: DataFrame, id_col: str = "hit_id", text_col: str = "text", path_col: str | None = "path") -> DataFrame:
    """(id, line_no, start, length) of each credential: its first line, counted by line feeds, and its offsets."""
    kind = dict(df.dtypes)[id_col]
    path = F.col(path_col).cast("string") if path_col in df.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, line, start, length = [], [], [], []
            for i, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for parts in find(t, p):
                    at.append(i), line.append(1 + t.count("\n", 0, parts[0][0])), start.append(parts[0][0]), length.append(parts[-1][1] - parts[0][0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(line, pa.int32()), pa.array(start, pa.int32()), pa.array(length, pa.int32())],
                                             names=["id", "line_no", "start", "length"])

    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), path.alias("p"))
            .mapInArrow(run, f"id {kind}, line_no int, start int, length int").withColumnRenamed("id", id_col))


def redact(df: DataFrame, text_col: str = "text", path_col: str | None = "path") -> DataFrame:
    """The table with the credentials of one column masked; all other columns, and the order of columns, unchanged."""
    path = F.col(path_col).cast("string") if path_col in df.columns else F.lit(None).cast("string")

    @F.pandas_udf("string")
    def masked(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([mask(t, q if isinstance(q, str) else None) for t, q in zip(s, p)], dtype=object)

    return df.withColumn(text_col, masked(F.col(text_col), path))
