"""Character classes and the address and domain patterns.

The classes spell out what ``\\w``, ``\\s`` and ``\\d`` mean for Unicode text,
so results do not depend on the regex flavour. ``\\z`` is the true end of text.
"""

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"
# The same white space, one by one, for trimming.
SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
SPACE_CODES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_CHARS = "".join(map(chr, SPACE_CODES))

# A terminal control sequence.
ANSI_CODE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"

LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
DOMAIN = rf"^{LABEL}(?:\.{LABEL})+\z"
DOMAIN_STRICT = rf"^(?:{LABEL}\.)+(?:[a-zA-Z0-9][a-zA-Z0-9\-]{{0,61}}[a-zA-Z0-9])\z"

EMAIL_PREFIX = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_BASIC = EMAIL_PREFIX + r"\z"
# One pass for every strict rule: local part of 1-64 characters without edge or
# double dots; an optional www. is dropped for good (possessive) before the
# domain is judged; a last label of letters only.
_ATOM = r"[a-z0-9_%+-]++"
_HOST_LABEL = r"(?!-)[a-z0-9-]{1,63}+(?<!-)"
EMAIL_STRICT = (
    rf"^(?=[^@]{{1,64}}@){_ATOM}(?:\.{_ATOM})*+@(?:www\.)?+(?:{_HOST_LABEL}\.)+[a-z]{{2,63}}\z"
)



def _address_token(letters: str) -> str:
    r"""Word-bounded address tokens as group 1, found in linear time.

    A plain ``\b[...]+@`` starts anew at every word boundary of a long run
    without an @. Here a run is entered once, at its start or where the last
    token ended (``\G``), skips to its first word boundary, and is left for
    good when no @ follows: later starts would reach the same end.
    """
    run, word = rf"[{letters}0-9._%+-]", rf"[{letters}0-9_]"
    entry = rf"(?:\G|(?<!{run}))(?={run})(?:\B(?:{word}++|[.%+-]++))?+\b"
    return rf"(?U){entry}({run}++@[{letters}0-9.-]+\.[{letters}]{{2,}}\b)"


EMAIL_TOKEN = _address_token("a-zA-Z")
# Ignoring case: four further letters fold to i, k and s.
EMAIL_TOKEN_FOLDED = _address_token(r"a-zA-Z\u0130\u0131\u017f\u212a")
