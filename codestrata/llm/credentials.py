"""Problem 2: literal credentials in chunks of source code, and their redaction.

A keyword automaton (Aho-Corasick) finds the texts and lines worth a look;
issuer formats, structural rules (URLs with passwords, connection strings,
headers, command lines, key blocks, split literals), assignments to secret names
and lines of configuration files are applied to those lines only. Issuers'
checksums and the JSON head of web tokens are validated: a value that passes is
proved; one that doesn't, or that has none, must have the structure of a secret.
Placeholders, references and values without it are dismissed; what remains is
replaced by a placeholder of the same length and character classes, which is
drawn with a key of the run, so that no secret can be found by trying.

Only the current row of an id counts (latest updated_at, nulls oldest, ties by
content). A null content has no lines; a null id is dropped.
"""

from __future__ import annotations

import base64
import hmac
import json
import math
import re
import secrets
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.shared import latest

#: What the automaton looks for, lower-cased.
KEYWORDS = (
    "secret", "passw", "passphrase", "pwd", "passwd", "token", "apikey", "api_key", "api-key", "credential", "bearer", "authorization",
    "auth", "private key", "private_key", "accountkey", "sharedaccesskey", "access_key", "accesskey", "access_id", "accessid", "signing", "login", "basic ", "pass\"", "pass ", "pass'",
    "pass=", "pass:", "_pass", "-----begin", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-",
    "sk_live", "sk-", "sk_", "rk_live", "pk_live", "aiza", "eyj", "npm_", "hf_", "old key", "://", "curl", "-u ", "key",
)

#: Formats of issuers, each with its own look.
ISSUERS = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|github_pat_\w{22,}|glpat-[\w\-]{20}"
    r"|xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})"
)
_PREFIX = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|(?:sk|rk)_live_|sk-|AIza|npm_|hf_|eyJ)")
#: What stands in the place of an issued secret.
_FILLED = re.compile(r"EXAMPLE|(?i:placeholder|your[-_]|example[-_]|[-_]example)|([A-Za-z0-9*])\1{7}")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"[a-z][a-z0-9+.\-]*://[^\s:/@'\"`]*:([^\s@/'\"`]+)@[\w\[]", re.I)
CONNECTION = re.compile(r"(?:^|[;\s\"'])(?:Password|Pwd|AccountKey|SharedAccessKey|SharedSecretValue)\s*=\s*([^;\"']+)", re.I)
HEADER = re.compile(r"^(?:bearer|token|basic|apikey)\s+([A-Za-z0-9+/=_\-.~]{8,})$", re.I)
COMMAND = (
    re.compile(r"--?(?:password|passwd|pass|token|secret|api-?key|auth)(?:=|\s+)(?:\\?['\"])?([^\s'\"\\]{4,})", re.I),
    re.compile(r"(?:^|[\s,;])(?:[A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY|ACCESS_KEY|CREDENTIALS?))=(?:\\?['\"])?([^\s,;'\"\\&]{4,})", re.I),
    re.compile(r"\bcurl\b.*?\s-u\s+[^\s:]+:(\S+)"),
)
#: How comments mention a credential that works.
REMARK = (
    re.compile(r"\b(?:fallback|old|temporary|temp|test|default|current|new|backup|legacy)\s+(?:token|key|password|secret|pass)\s+(?:was|is|:)?\s*(\S{6,})", re.I),
    re.compile(r"\b(?:login|log in|sign in)\s+(?:with|as)\s+\S+\s*/\s*(\S{6,})", re.I),
    re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_ -]?key)\s*(?:[:=]|\bis\b)\s*(\S{6,})", re.I),
)
_NAME = re.compile(
    r"(?:^|[^a-z])(?:secret|secrets|password|passwd|passphrase|pwd|pass|token|apikey|api_?key|credentials?|bearer|authorization"
    r"|private_?key|access_?key|access_id|access_?token|signing_?key|encryption_?key|auth_?key|auth|secret_pair|session|grant|login)(?:$|[^a-z])"
)
#: Last words of names that speak about a secret without being one.
_ABOUT = {
    "name", "names", "hint", "header", "headers", "field", "fields", "id", "ids", "path", "file", "url", "uri", "type", "kind", "label", "policy", "length", "size", "count",
    "regex", "pattern", "prompt", "message", "ref", "reference", "key_name", "placeholder", "example", "digest", "hash", "checksum", "sha", "sha256", "md5", "etag", "fingerprint",
    "format", "prefix", "suffix", "param", "parameter", "env", "var", "variable", "column", "title", "text", "error", "expiry", "ttl", "scope", "status", "endpoint",
    "lifetime", "limit", "row", "commit", "revision", "public", "charset", "alphabet",
}
_ASSIGN = re.compile(
    r"""(?P<name>[A-Za-z_$][\w$\-]*)["'`]?\]?\)?\s*(?::\s*&?(?:'static\s+)?[A-Za-z_\[][\w<>\[\]]*\s*)?(?P<sign>:=|=>|=|:|,|\s)\s*(?P<paren>\(?)\s*(?P<quote>["'`])(?P<value>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)(?P<rest>.*)"""
)
#: A line of a configuration file: a name and an unquoted value that is the rest of the line but for a remark.
CONFIG = re.compile(r"^\s*(?:export\s+|set\s+|-\s+|ENV\s+)?(?P<name>[A-Za-z_][\w.\-]*)\s*(?:=|:\s)\s*(?P<value>[^\s'\"`;,(){}\[\]<>$|\\]{8,})\s*(?:#.*)?$")
_STRING = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
_PLACEHOLDER = re.compile(
    r"^(?:[x*.\-_#0?]+|change[-_ ]?(?:me|it|this)|dummy|example|sample|test|none|null|nil|true|false|redacted|removed|hidden|masked|todo|tbd|secret|password|passwd|token"
    r"|replace[-_ ]?(?:me|this).*|your[-_ ].*|my[-_ ].*|<.*>|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|\{.*\}|%\(.*\)[sd]|%[sd]|\$[A-Z_]+|#\{.*\}|env:.*|vault:.*|ssm:.*|file:.*|os\.\w+.*|process\.env.*|getenv.*"
    r"|secrets?/.*|arn:.*|projects/.*|@@.*@@|\[.*\]|insert.*here|.*(?:placeholder|[-_ ]here)|foo(?:bar)?|bar|baz|abc(?:123)?|1234\d*)$",
    re.I,
)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_SEQUENCE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def words_of(name: str) -> list[str]:
    """Parts of an identifier, lower-cased: ``dbPassword`` and ``DB_PASSWORD`` are ``db``, ``password``."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def secret_name(name: str) -> bool:
    words = words_of(name)
    if words[-2:] == ["access", "id"]:
        return True
    return bool(words) and words[-1] not in _ABOUT and bool(_NAME.search("_" + "_".join(words) + "_"))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def proved(value: str) -> bool:
    """Whether an issued value carries a checksum that is right, or decodes to what its issuer writes."""
    m = re.fullmatch(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})", value)
    if m:
        crc, digits = zlib.crc32(m[1].encode()), ""
        for _ in range(6):
            crc, d = divmod(crc, 62)
            digits = _BASE62[d] + digits
        return digits == m[2]
    if value.startswith("eyJ"):
        head = value.split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, TypeError):
            return False
    return False


def sham(value: str) -> bool:
    """Whether a value has an issuer's format only: one that manuals show, or filled up with few letters."""
    if proved(value):
        return False
    body = _PREFIX.sub("", value)
    return bool(_FILLED.search(body) or _PLACEHOLDER.match(body)) or len(set(body)) < 6 or body[:12] in _SEQUENCE


def placeholder(value: str) -> bool:
    """Whether a value stands for a secret, refers to one or can't be one."""
    v = value.strip()
    if ISSUERS.fullmatch(v) and sham(v):
        return True
    return (
        len(v) < 6 or bool(_PLACEHOLDER.match(v)) or bool(_UUID.match(v)) or "${" in v or "{{" in v or len(set(v)) < 4
        or v[:12] in _SEQUENCE or v.startswith(("data:", "http://", "https://", "/", "./"))
    )


def secret_value(value: str) -> bool:
    """Whether a value that is given to a secret name looks chosen or drawn rather than descriptive."""
    if placeholder(value) or re.search(r"\s", value) or not value.isascii():
        return False
    if re.search(r"\d", value) or re.search(r"[^\w\-./]", value):
        return True
    return bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)) and len(value) >= 12 and not re.fullmatch(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*", value)


def drawn(value: str) -> bool:
    """Whether an unquoted value looks drawn: letters and digits of mixed case or with marks, no name, number or path."""
    kinds = [bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w.\-/:]")]
    if not kinds[2] or sum(kinds) < 3 or re.fullmatch(r"[A-Za-z_][\w\-]*(?:[.:/]+[A-Za-z_][\w\-]*)+", value):
        return False
    return secret_value(value) and entropy(value) > 2.5


def _in_literal(value: str) -> list[str]:
    """Secrets inside a string literal whose name says nothing: URLs, connection strings, headers and commands."""
    found = [m[0] for m in ISSUERS.finditer(value) if not placeholder(m[0])]
    for m in URL.finditer(value):
        if not (placeholder(m[1]) or re.fullmatch(r"\{\w*\}|\$\w+|<\w+>|\*+|:\w+|%s", m[1])):
            found.append(m[1])
    header = HEADER.match(value)
    if header and not placeholder(header[1]) and re.search(r"\d", header[1]):
        found.append(header[1])
    if "=" in value or "--" in value:
        for pattern in (CONNECTION, *COMMAND[:2]):
            found += [m[1] for m in pattern.finditer(value) if not placeholder(m[1]) and not m[1].startswith(("$", "{", "<", "%"))]
    return found


def credentials_of(text: str, candidate_lines: list[int]) -> list[tuple[int, str]]:
    """(1-based line, secret) of every literal credential that begins on one of the given 0-based lines."""
    lines = text.split("\n")
    found: list[tuple[int, str]] = []
    for n in candidate_lines:
        line = lines[n]
        hits: list[str] = []
        block = KEY_BLOCK.search(line)
        if block:
            inline = line[block.end() :].split("-----END")[0].strip(" \"'`;,")
            body = inline if re.search(r"[A-Za-z0-9+/=]{24,}", inline) else "\n".join(_block_body(lines, n))
            if body:
                found.append((n + 1, body))
                continue
        hits += [m[0] for m in ISSUERS.finditer(line) if not placeholder(m[0])]
        for m in _STRING.finditer(line):
            hits += _in_literal(m[2])
        if " --" in line:
            hits += [m[1] for m in COMMAND[0].finditer(line) if not placeholder(m[1]) and not m[1].startswith(("$", "{", "<", "%"))]
        for m in _assignments(line):
            value = m["value"]
            if not secret_name(m["name"]):
                continue
            split = re.match(r"\s*(?:\+|\.|\\|\.\.|<<|&)\s*\\?$", m["rest"]) or (m["paren"] and not m["rest"].strip())
            if split:
                if not placeholder(value + _continued(lines, n)) and secret_value(value + _continued(lines, n)):
                    hits.append(value)
            elif (m["sign"].strip() or line.lstrip().startswith("#define")) and secret_value(HEADER.sub(r"\1", value)):
                hits.append(HEADER.sub(r"\1", value))
        config = CONFIG.match(line)
        if config and secret_name(config["name"].split(".")[-1]) and drawn(config["value"]):
            hits.append(config["value"])
        if re.match(r"\s*(?://|#|\*|/\*|--)", line):
            curl = COMMAND[2].search(line)
            if curl and not placeholder(curl[1]):
                hits.append(curl[1])
            for pattern in REMARK:
                for m in pattern.finditer(line):
                    value = m[1].rstrip(".,;)\"'`")
                    if secret_value(value) and (re.search(r"\d", value) or entropy(value) > 3.4) and not re.fullmatch(r"[a-z]+(?:_[a-z]+)*", value):
                        hits.append(value)
        else:
            curl = COMMAND[2].search(line)
            if curl and not placeholder(curl[1].rstrip("\"'`;,")):
                hits.append(curl[1].rstrip("\"'`;,"))
        found += [(n + 1, h) for h in dict.fromkeys(h for h in hits if h)]
    return found


def _assignments(line: str) -> Iterator[re.Match[str]]:
    at = 0
    while m := _ASSIGN.search(line, at):
        yield m
        at = m.end("value")


def _continuations(lines: list[str], n: int) -> Iterator[tuple[int, re.Match[str]]]:
    """(index, match) of the literals on the next lines that continue a split one; group 2 is the value."""
    for k in range(n + 1, len(lines)):
        m = re.match(r"""\s*(["'`])((?:\\.|(?!\1)[^\\\n])*)\1\s*(\+|\.|\\|\)|;|,)?""", lines[k])
        if not m:
            return
        yield k, m
        if m[3] not in ("+", ".", "\\"):
            return


def _continued(lines: list[str], n: int) -> str:
    return "".join(m[2] for _, m in _continuations(lines, n))


#: A line of a key block: marks of comments and literals, then letters of base64, then marks; or a header, or nothing.
_BODY = re.compile(r"""(?P<before>[\s#*"']*(?://+\s+)?[\s"']*(?:\+\s+["'])?)(?P<key>[A-Za-z0-9+/]+={0,2})(?P<after>(?:\\[nr])*[\s"'+,;.\\)]*)""")
_BLOCK_HEADER = re.compile(r"""[\s/#*"'+]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset)\s*:.*|[\s/#*"'+,;.\\nr]*""")


def _block_body(lines: list[str], n: int) -> list[str]:
    """The lines of a key block after its first, up to the line that ends it or stops looking like one.

    Lines of a few letters are part of it too, if the block is ended, or if they end in the padding of base64.
    """
    end = next((k for k in range(n + 1, len(lines)) if "-----END" in lines[k] or not (_BODY.fullmatch(lines[k]) or _BLOCK_HEADER.fullmatch(lines[k]))), len(lines))
    body = lines[n + 1 : end]
    if not (end < len(lines) and "-----END" in lines[end]):
        long_ = lambda x: (m := _BODY.fullmatch(x)) is not None and (len(m["key"]) >= 16 or m["key"].endswith("="))
        body = body[: next((k for k, x in enumerate(body) if not (long_(x) or _BLOCK_HEADER.fullmatch(x))), len(body))]
    return body if any((m := _BODY.fullmatch(x)) is not None and len(m["key"]) >= 16 for x in body) else []


class Finder:
    """The keyword automaton and the rules behind it."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word in KEYWORDS:
            self.automaton.add_word(word, len(word))
        self.automaton.make_automaton()

    def candidate_lines(self, text: str) -> list[int]:
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length; positions must not move
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        lines, at, n = [], 0, 0
        for end, _ in self.automaton.iter(low):
            if end < at:
                continue
            n += low.count("\n", at, end)
            lines.append(n)
            stop = low.find("\n", end)
            if stop < 0:
                break
            at = stop
        return list(dict.fromkeys(lines))

    def __call__(self, text: str | None) -> list[tuple[int, str]]:
        if not text:
            return []
        lines = self.candidate_lines(text)
        return credentials_of(text, lines) if lines else []


def disguise(secret: str, key: bytes) -> str:
    """A placeholder of the same length whose letters, digits and marks stand where they stood.

    It is drawn from the secret by a keyed hash, so equal secrets stay equal under one key; prefixes that name
    an issuer stay readable, and escapes such as ``\\n`` stay as they are.
    """
    seed = hmac.digest(key, secret.encode("utf-8", "surrogatepass"), "sha256")
    kept = re.match(r"(?:AKIA|ASIA|gh[pousr]_|xox[a-z]-|sk_live_|sk-|eyJ)?", secret)
    still = set(range(kept.end() if kept else 0)) | {k for m in re.finditer(r"\\.", secret) for k in range(*m.span())}
    out = []
    for i, c in enumerate(secret):
        b = seed[i % 32] + i * 7
        if i in still or not c.isalnum():
            out.append(c)
        elif c.isdigit():
            out.append(chr(48 + b % 10))
        else:
            out.append(chr((65 if c.isupper() else 97) + b % 26))
    return "".join(out)


def redact(text: str, found: list[tuple[int, str]], key: bytes) -> str:
    """``text`` with every found secret disguised; lengths and line breaks stay."""
    lines = text.split("\n")
    for number, secret in found:
        block = KEY_BLOCK.search(lines[number - 1]) and "\n".join(_block_body(lines, number - 1)) == secret
        if block:
            for k in range(number, number + secret.count("\n") + 1):
                m = _BODY.fullmatch(lines[k])
                if m and not _BLOCK_HEADER.fullmatch(lines[k]):
                    lines[k] = m["before"] + disguise(m["key"], key) + m["after"]
        else:
            lines[number - 1] = lines[number - 1].replace(secret, disguise(secret, key))
            if re.match(r"^.*(?:\+|\.|\\|\()\s*$", lines[number - 1]):
                for k, m in list(_continuations(lines, number - 1)):
                    lines[k] = lines[k][: m.start(2)] + disguise(m[2], key) + lines[k][m.end(2) :]
    return "\n".join(lines)


def _scan(redacted: bool, key: bytes):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder()
        for b in batches:
            found = [find(t) for t in b["content"]]
            out = {"id": b["id"], "updated_at": b["updated_at"], "digest": b["digest"], "lines": [sorted({n for n, _ in f}) for f in found]}
            if redacted:
                out["redacted"] = [redact(t, f, key) if f else t for t, f in zip(b["content"], found, strict=True)]
                out["n_proved"] = [sum(proved(x) for _, x in f) for f in found]
            yield pd.DataFrame(out)

    return rows


def chunk_credentials(chunks: DataFrame, redacted: bool = False, key: bytes | None = None) -> DataFrame:
    """(id, lines array<int>[, redacted, n_proved]): the lines on which credentials begin, one row per current id.

    ``n_proved`` counts those whose checksum or head was validated. Without a ``key`` one is drawn for this run.
    The scan is one pass of map tasks over the chunks; only (id, time, lines) is
    shuffled to choose the current row of an id, the text only if it is asked for.
    """
    rows = chunks.where("id IS NOT NULL").select("id", "updated_at", "content", F.xxhash64("content").alias("digest"))
    schema = "id string, updated_at timestamp, digest bigint, lines array<int>" + ", redacted string, n_proved int" * redacted
    columns = ["lines"] + ["redacted", "n_proved"] * redacted
    scan = _scan(redacted, key or secrets.token_bytes(32))
    return latest(rows.mapInPandas(scan, schema), "id", ["updated_at", "digest"], columns)
