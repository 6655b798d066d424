"""SQL fragments used by several oracle queries (RE2 syntax)."""

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[^{SPACE}]+')"


def count_words(expr: str) -> str:
    return f"CAST(len({words(expr)}) AS BIGINT)"


def clean_patterns(expr: str, decomposed: bool = False) -> str:
    """All cleaning rules; ``decomposed``: as if accents were separate marks inside the words."""
    plain = "AND strip_accents(x) = x" if decomposed else ""
    e = f"""CASE WHEN regexp_matches({expr}, '\\p{{Lu}}{{2}}') THEN array_to_string(list_transform(
      regexp_extract_all({expr}, '[{WORD}]+|[^{WORD}]+'),
      lambda x: CASE WHEN regexp_full_match(x, '\\p{{Lu}}{{2,}}') {plain} THEN x[1] || lower(x[2:]) ELSE x END), '')
      ELSE {expr} END"""
    e = f"strip_accents({e})" if decomposed else e
    for pattern, to in (
        (r"[^\p{L}\p{N}\p{Z}\p{P}\p{S}\n]", ""),
        (r"[\x{200B}-\x{200F}\x{FEFF}\p{Z}]", " "),
        ("[‹›«»]", '"'),
        ("[`′´]", "''"),
        (r"\([^)]*(?:q\.v\.|cf\.)[^)]*\)", ""),
        ("[‒–—―]", "-"),
        (r"[\s\x{0b}]*([,.!?:;)])", r"\1"),
        (r"(\()[\s\x{0b}]*|[\s\x{0b}]*(\))", r"\1\2"),
        (r"(?m)^ +| +$|[\t\x{0b}\f\r ]+", " "),
        (r"\n{3,}", "\n\n"),
    ):
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return strip(e)


def sentence_tokens(where: str = "", source: str = "documents") -> str:
    """doc_id, sent_no, tokens: text cut after a sentence mark, its closers and white space (no look-behind in RE2)."""
    marked = rf"""regexp_replace(text, '([.!?。！？।؟]["''”’»)\]}}」』）]{{0,3}})[{SPACE}]+', '\1' || chr(1), 'g')"""
    return f"""SELECT doc_id, CAST(u.sent_no - 1 AS INTEGER) AS sent_no, {words('u.sentence')} AS tokens
      FROM (SELECT doc_id, string_split({marked}, chr(1)) AS parts FROM {source} {where}) d,
      LATERAL (SELECT unnest(d.parts) AS sentence, generate_subscripts(d.parts, 1) AS sent_no) u"""


def windows(max_context: int, where: str = "", source: str = "documents") -> str:
    return f"""SELECT doc_id, sent_no, w.i AS i, w.next AS next, w.context AS context, w.size AS context_size
      FROM (SELECT doc_id, sent_no, unnest(list_transform(range(1, len(tokens)), lambda i: struct_pack(
        i := i, next := tokens[i + 1], size := least(i, {max_context}),
        context := array_to_string(tokens[greatest(i - {max_context}, 0) + 1 : i], ' ')))) AS w
      FROM ({sentence_tokens(where, source)}) s)"""
