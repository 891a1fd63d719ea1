import html
import re
from html.entities import html5

from gazette.functions.entities import unescape_entities, unescape_text


def test_every_name_decodes_like_the_standard_library(evaluate):
    raw = [f"a &{name} b&{name}" for name in html5]
    assert evaluate(unescape_entities, raw) == [html.unescape(t) for t in raw]


def test_numeric_references(evaluate):
    codes = [0, 1, 9, 10, 11, 13, 31, 32, 39, 65, 127, 128, 129, 150, 159, 160, 255, 256, 8217, 55296,
             57343, 64976, 65533, 65534, 65535, 128512, 131070, 1114109, 1114111, 1114112, 10**12, 10**30]
    raw = [f"x&#{n};y" for n in codes] + [f"x&#x{n:x}y;&#X{n:X};" for n in codes] + ["&#0039;", "&#39", "&#x00027;"]
    assert evaluate(unescape_entities, raw) == [html.unescape(t) for t in raw]


def test_names_without_semicolon_take_the_longest_prefix(evaluate):
    raw = ["&notit;", "&amp&ampx", "&eacutes", "&unknown;", "& &; &&amp;", "&copyright", "&AMP", "a&b=1&lt=2", "", "plain"]
    assert evaluate(unescape_entities, raw) == [html.unescape(t) for t in raw]


def test_text_clean_up(evaluate):
    def expected(t):
        t = re.sub(r"&#\d+;", "'", html.unescape(t or ""))
        return "".join(c for c in t if ord(c) >= 32 or c in "\n\t").strip()

    raw = ["&amp;#39;", "&amp;#0039; l&#039;air", "a\x00b\x0bc\rd\te\nf\x1f", "  x 　", None, "", "&nbsp;x&nbsp;"]
    assert evaluate(unescape_text, raw) == [expected(t) for t in raw]
