"""Licence scans: Aho-Corasick over words for notices and over text for identifier tags, a shunting-yard for expressions.

One automaton holds the notice phrases; it runs over the words of a text joined by single blanks, so a match is a run
of whole words. Another holds the tags; the expression after a tag, to the end of its line, is read by a shunting-yard
parser (WITH binds closest, then AND, then OR; brackets) and evaluated against the licences that are known: an identifier
counts as known if it is in LICENCES with one of its versions (a + may follow; GNU licences take -only and -or-later), X WITH
E needs a known identifier and a known exception, AND needs both sides, OR either.

labels are those of the notices and, for each expression that evaluates to true, the families of its identifiers. The
score is 1 for a text with a true expression, else 1 - 2^-n for n notices, else 0.5 with an expression that is false or can't be read,
else 0. Texts are scanned one by one: the automata run in C over a whole text.

Cases: a null or empty text has no words, no labels and a score of 0; very long texts are handled alone; repeated rows
each get a row; ids of any type and null ids are handed on as they are; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, quoted

# The notices and their labels.
NOTICES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that give a label of the method's own.
MORE_NOTICES = {
    "under cc by": "cc-by", "creative commons attribution": "cc-by", "bsd license": "bsd", "mozilla public license": "mpl", "isc license": "isc", "eclipse public license": "epl", "boost software license": "bsl",
    "european union public licence": "eupl", "artistic license": "artistic", "common development and distribution license": "cddl", "zlib license": "zlib", "sil open font license": "ofl",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# Identifiers of the SPDX list, in lower case, by family: a name and, after it, the versions it may have.
LICENCES = {
    "afl": "afl 1.1 1.2 2.0 2.1 3.0", "apache": "apache 1.0 1.1 2.0", "apsl": "apsl 1.0 1.1 1.2 2.0", "artistic": "artistic 1.0 1.0-cl8 1.0-perl 2.0", "beerware": "beerware", "blueoak": "blueoak 1.0.0",
    "bsd": "0bsd|bsd 1-clause 2-clause 2-clause-patent 2-clause-views 3-clause 3-clause-attribution 3-clause-clear 3-clause-lbnl 3-clause-modification 3-clause-no-nuclear-license 3-clause-open-mpi 4-clause 4-clause-shortened 4-clause-uc protection source-code",
    "bsl": "bsl 1.0", "busl": "busl 1.1", "bzip2": "bzip2 1.0.6", "cc0": "cc0 1.0", "cc-by": "|".join(f"cc-by{x} 1.0 2.0 2.5 3.0 4.0" for x in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd")),
    "cddl": "cddl 1.0 1.1", "cecill": "cecill 1.0 1.1 2.0 2.1|cecill-b|cecill-c", "cpal": "cpal 1.0", "cpl": "cpl 1.0", "curl": "curl", "ecl": "ecl 1.0 2.0", "efl": "efl 1.0 2.0", "epl": "epl 1.0 2.0", "eupl": "eupl 1.0 1.1 1.2",
    "fair": "fair", "ftl": "ftl", "hpnd": "hpnd", "icu": "icu", "ijg": "ijg", "info-zip": "info-zip", "intel": "intel", "ipl": "ipl 1.0", "isc": "isc", "json": "json", "libpng": "libpng|libpng 2.0", "lpl": "lpl 1.0 1.02",
    "lppl": "lppl 1.0 1.1 1.2 1.3a 1.3c", "mit": "mit|mit 0|mit-advertising|mit-cmu|mit-enna|mit-feh|mit-modern-variant|mitnfa", "mpl": "mpl 1.0 1.1 2.0 2.0-no-copyleft-exception", "ms": "ms-pl|ms-rl", "mulanpsl": "mulanpsl 1.0 2.0",
    "nasa": "nasa 1.3", "ncsa": "ncsa", "npl": "npl 1.0 1.1", "ntp": "ntp", "odbl": "odbl 1.0", "odc-by": "odc-by 1.0", "ofl": "ofl 1.0 1.0-rfn 1.0-no-rfn 1.1 1.1-rfn 1.1-no-rfn", "oldap": "oldap 1.1 1.2 1.3 1.4 2.0 2.0.1 2.1 2.2 2.3 2.4 2.5 2.6 2.7 2.8",
    "openssl": "openssl", "osl": "osl 1.0 1.1 2.0 2.1 3.0", "pddl": "pddl 1.0", "php": "php 3.0 3.01", "postgresql": "postgresql", "python": "psf 2.0|python 2.0 2.0.1|cnri-python", "qpl": "qpl 1.0", "rpl": "rpl 1.1 1.5", "ruby": "ruby",
    "sissl": "sissl|sissl 1.2", "sleepycat": "sleepycat", "spl": "spl 1.0", "sspl": "sspl 1.0", "tcl": "tcl", "unicode": "unicode 3.0|unicode-dfs 2015 2016|unicode-tou", "unlicense": "unlicense", "upl": "upl 1.0", "vim": "vim",
    "w3c": "w3c", "wtfpl": "wtfpl", "x11": "x11", "xnet": "xnet", "zend": "zend 2.0", "zlib": "zlib|zlib-acknowledgement", "zpl": "zpl 1.1 2.0 2.1",
}
# GNU licences, whose versions may be followed by -only or -or-later.
GNU = {"gpl": "gpl 1.0 2.0 3.0|lgpl 2.0 2.1 3.0|agpl 1.0 3.0", "gfdl": "gfdl 1.1 1.2 1.3"}
# Exceptions of the SPDX list, in lower case.
EXCEPTIONS = frozenset(
    """389-exception asterisk-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0
    cryptsetup-openssl-exception digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gmsh-exception
    gnat-exception gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005 gstreamer-exception-2008 i2p-gpl-java-exception lgpl-3.0-linking-exception libtool-exception
    linux-syscall-note llvm-exception lzma-exception mif-exception nokia-qt-exception-1.1 ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 openvpn-openssl-exception
    ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 rrdtool-floss-exception-2.0 sane-exception shl-2.0 shl-2.1 stunnel-exception swift-exception
    texinfo-exception u-boot-exception-2.0 universal-foss-exception-1.0 vsftpd-openssl-exception wxwindows-exception-3.1 x11vnc-openssl-exception""".split()
)
#: A word of every notice: texts without any of them are not scanned by word.
HINTS = (b" license ", b" licence ", b" cc ", b" commons ")
BINDING = {"or": 1, "and": 2, "with": 3}

GAP_TABLE = bytes(0x20 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 0x20 if 0x41 <= b < 0x5B else b for b in range(256))
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
BLANKS = re.compile(r"\s*")


@lru_cache(1)
def automata():
    import ahocorasick

    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        words.add_word(f" {phrase} ", (len(phrase) + 1, label, True))
    for phrase, label in MORE_NOTICES.items():
        words.add_word(f" {phrase} ", (len(phrase) + 1, label, False))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    words.make_automaton()
    tags.make_automaton()
    return words, tags


@lru_cache(1)
def identifiers() -> dict[str, str]:
    """Every identifier that is known, with its family."""
    out = {}
    for table, endings in ((LICENCES, ("",)), (GNU, ("", "-only", "-or-later"))):
        for label, names in table.items():
            for name, *versions in map(str.split, names.split("|")):
                for full in [f"{name}-{v}" for v in versions] or [name]:
                    out |= {full + e: label for e in endings}
    return out


def family(identifier: str) -> str | None:
    """The family of an SPDX identifier in lower case, if it is known."""
    return identifiers().get(identifier.removesuffix("+"))


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands in order, operators after their operands; ValueError if it is no expression."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t in BINDING:
            if operand:
                raise ValueError("an operator without its left side")
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                raise ValueError("a bracket after an operand")
            stack.append(t)
        elif t == ")":
            if operand:
                raise ValueError("a bracket closed too early")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("a bracket that wasn't opened")
            stack.pop()
        else:
            if not operand:
                raise ValueError("two operands side by side")
            out.append(t)
            operand = False
    if operand or "(" in stack:
        raise ValueError("it breaks off")
    return out + stack[::-1]


def leading(expression: str) -> list[str]:
    """The tokens of the longest leading part that is a whole expression, found in one pass."""
    tokens, at, good, operand, depth = [], 0, 0, True, 0
    lowered = expression.lower()
    while m := TOKEN.match(lowered, BLANKS.match(lowered, at).end()):
        word, at = m[0] if m[0] in "()" else m[0].rstrip(".:"), m.end()
        if word in BINDING or word == ")":
            if operand:
                break
            operand = word != ")"
        elif not operand:
            break
        elif word != "(":
            operand = False
        depth += (word == "(") - (word == ")")
        if depth < 0:
            break
        tokens.append(word)
        if not operand and not depth:
            good = len(tokens)
    return tokens[:good]


def evaluate(expression: str) -> tuple[bool, set[str]]:
    """Whether known licences satisfy the longest leading expression, and the families that make it true."""
    if not (tokens := leading(expression)):
        raise ValueError("no expression")
    stack: list[tuple[bool, set[str], str | None]] = []  # whether it holds, its families, the identifier if it is one
    for t in postfix(tokens):
        if t not in BINDING:
            f = family(t)
            stack.append((f is not None, {f} if f else set(), t))
            continue
        (b, bs, right), (a, as_, left) = stack.pop(), stack.pop()
        if t == "with":
            ok = a and left is not None and right in EXCEPTIONS
            stack.append((ok, as_ if ok else set(), None))
        elif t == "and":
            stack.append((a and b, as_ | bs if a and b else set(), None))
        else:
            stack.append((a or b, (as_ if a else set()) | (bs if b else set()), None))
    return stack[0][:2]


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    words, tags = automata()
    normal = text.encode().translate(GAP_TABLE).split()
    n = len(normal)
    joined = b" " + b" ".join(normal) + b" "
    starts, base, more = [], set(), set()
    if any(x in joined for x in HINTS):
        shown, at, count = joined.decode(), 0, -1
        for end, (size, label, counted) in words.iter(shown):
            if not counted:
                more.add(label)
                continue
            begin = end - size
            count += shown.count(" ", at, begin + 1)
            at = begin + 1
            starts.append(count)
            base.add(label)
    true, read = False, False
    if "icense-" in (lowered := text.lower()):  # other characters' lower case may differ in length, but is no part of a tag or an identifier
        for end, _ in tags.iter(lowered):
            stop = lowered.find("\n", end)
            read = True
            try:
                ok, found = evaluate(lowered[end + 1 : stop if stop >= 0 else None])
            except ValueError:
                continue
            true |= ok
            more |= found if ok else set()
    score = 1.0 if true else 1 - 0.5 ** min(len(starts), 40) if starts else 0.5 if read else 0.0
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def licence_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    kinds = [("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()), ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]

    def fn(texts: pa.Array) -> list[pa.Array]:
        rows = [scan(t) for t in texts.to_pylist()]
        return [pa.array([r[i] for r in rows], k) for i, (_, _, k) in enumerate(kinds)]

    return map_texts(df, text_col, [(id_col, quoted(id_col))], [T.StructField(n, t) for n, t, _ in kinds], fn)


def op9_licences(spark, sf_dir):
    """The documents' licence notices and tags."""
    from .common import table

    return licence_scan(table(spark, sf_dir, "documents"))
