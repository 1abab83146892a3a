"""The registered queries as SQL for DuckDB, over the same whole tables.

Named sub-queries stand in ``PARTS``; ``_sql`` puts those a query needs in front of it. Fixed
texts and numbers come from ``gradelens.values``; every rule is written out here again.
"""

from __future__ import annotations

import re
from string import Formatter

from gradelens import values as v

NL = "chr(10)"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = (
    "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '"
    "||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)"
    "||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)"
    "||chr(8239)||chr(8287)||chr(12288))"
)
CELL = "model, condition, task"
LETTER_COLUMNS = "score_a, score_b, score_c, score_d"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(template: str, slots: dict[str, str]) -> str:
    pieces = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(_text(literal))
        if slot is not None:
            pieces.append(slots[slot])
    return " || ".join(pieces)


def _strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def _squash(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def _cut(x: str, n: int) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, {NL}), lambda l: substring(l, {n + 1})), {NL})"
    )


def _numbered(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, {NL}), "
        f"lambda l, i: i::VARCHAR || ' ' || substring(l, 2)), {NL})"
    )


def _bare(x: str) -> str:
    slashes = rf"regexp_replace({x}, '(?s)/\*.*?\*/|//[^\n]*', '', 'g')"
    return rf"regexp_replace({slashes}, '(?m)^{WS}*#[^\n]*', '', 'g')"


def _cleaned(x: str) -> str:
    out = _strip(x)
    out = rf"regexp_replace({out}, '^```[^\n]*\n?', '')"
    out = rf"regexp_replace({out}, '\n?```(\n?)$', '\1')"
    out = rf"regexp_replace({out}, '^\[[^\]]+\]\n?', '')"
    return rf"regexp_replace({out}, '\n?\[/[^\]]+\](\n?)$', '\1')"


def _offsets(lines: str) -> str:
    return (
        f"list_transform(range(0, len({lines}) + 1), lambda i: "
        f"coalesce(list_sum(list_transform({lines}[1:i], lambda l: length(l))), 0)::BIGINT)"
    )


def _hit_offsets(gold: str, pred: str, offsets: str) -> str:
    return (
        f"(len(list_filter({offsets}, lambda j: j + length({gold}) <= length({pred}) "
        f"AND substring({pred}, j + 1, length({gold})) = {gold})) > 0)::INT"
    )


def _last_score(letter: str) -> str:
    return (
        f"coalesce(list_filter(logprobs, lambda e: trim(e.token, ' ' || {NL}) = '{letter}')[-1]"
        f".logprob, {v.UNSEEN_LOGPROB}::DOUBLE)"
    )


PHRASE = "CASE {0} " + " ".join(
    f"WHEN '{name}' THEN '{phrase}'" for name, phrase in v.CHANGE_PHRASES.items()
) + " END"


def _ids_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda n: n::VARCHAR), ',')"


def _lists_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda o: {_ids_text('o')}), '|')"


def _prompt(template: str, **slots: str) -> str:
    section = _filled(v.SUMMARY_SECTION, {"summary": "coalesce(summary, '')"})
    common = {
        "lang": f"'{v.DEFAULT_LABEL}'",
        "code_snippet": "numbered",
        "code_review": "review",
        "summary_section": f"CASE WHEN condition = 'summary' THEN {section} ELSE '' END",
        "ct": PHRASE.format("type_correct"),
    }
    return _filled(template, common | slots)


PARTS = {
    "golds": f"SELECT doc_id, text, lang, source, '// note ' || doc_id || {NL} || text AS gold FROM documents",
    "pairs": f"""
        SELECT doc_id, gold, CASE doc_id % 11
          WHEN 0 THEN gold WHEN 1 THEN gold || {NL} || 'tail'
          WHEN 2 THEN replace(gold, ' ', '  ') WHEN 3 THEN text
          WHEN 4 THEN 'intro' || {NL} || gold WHEN 5 THEN replace(gold, ' ', '')
          WHEN 6 THEN '# c' || {NL} || gold || {NL} || '/* x' || {NL} || ' y */'
          WHEN 7 THEN '' WHEN 8 THEN 'ab' || {NL} || 'q ' || gold
          WHEN 9 THEN 'x' || gold ELSE replace(gold, ' ', chr(160)) END AS pred
        FROM golds""",
    "codes": f"""
        SELECT doc_id, '/* head' || {NL} || ' more */'
          || replace(text, '. ', '. // aside' || {NL} || {NL} || '  # note' || {NL})
          || {NL} || 'http://u/v' || {NL} || '#include <x>' || {NL} || '/* open' || {NL}
          || text AS code FROM documents""",
    "item_count": "SELECT count(*) AS items FROM benchmark",
    "placed_golds": "SELECT g.*, g.doc_id % items AS item_id FROM golds g, item_count",
    "reviewed": """
        SELECT g.* EXCLUDE (item_id), b.text AS review FROM placed_golds g JOIN benchmark b USING (item_id)""",
    "exs": f"""
        SELECT doc_id AS example_id, lang, review,
          ' ' || replace(text, {NL}, {NL} || ' ') AS old,
          '+' || replace(gold, {NL}, {NL} || '+') AS new,
          CASE doc_id % 3 WHEN 0 THEN 'add_only' WHEN 1 THEN 'remove_only' ELSE 'modify' END AS type_correct,
          CASE doc_id % 3 WHEN 0 THEN ['remove_only', 'modify'] WHEN 1 THEN ['add_only', 'modify']
            ELSE ['add_only', 'remove_only'] END AS type_wrong,
          [doc_id % 5 + 1, doc_id % 5 + 2] AS loc_correct,
          [[doc_id % 5 + 20],
           CASE WHEN doc_id % 50 = 0 THEN [doc_id % 5 + 1, doc_id % 5 + 2]
             ELSE [doc_id % 5 + 21, doc_id % 5 + 22] END,
           [doc_id % 5 + 23]] AS loc_wrong_easy,
          [[doc_id % 5 + 1], [doc_id % 5 + 2], [doc_id % 5 + 2, doc_id % 5 + 3]] AS loc_wrong_hard,
          gold AS solution_correct,
          [gold || 'x', gold || 'y', CASE WHEN doc_id % 50 = 7 THEN gold ELSE gold || 'z' END] AS solution_wrong_easy,
          ['x' || gold, 'y' || gold, 'z' || gold] AS solution_wrong_hard,
          CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'ERROR: timeout'
            ELSE source || ' changed as asked: ' || review END AS summary
        FROM reviewed""",
    "numbered_exs": f"SELECT *, {_numbered('old')} AS numbered FROM exs",
    "conditions": "SELECT unnest([0, 1]) AS c, unnest(['plain', 'summary']) AS condition",
    "models": "SELECT unnest([0, 1]) AS m, unnest(['m0', 'm1']) AS model",
    "slots": "SELECT unnest([1, 2, 3, 4]) AS s",
    "orders": """
        SELECT 4 AS k, row_number() OVER (ORDER BY a.s, b.s, c.s, d.s) - 1 AS p, [a.s, b.s, c.s, d.s] AS o
        FROM slots a, slots b, slots c, slots d
        WHERE a.s <> b.s AND a.s <> c.s AND a.s <> d.s AND b.s <> c.s AND b.s <> d.s AND c.s <> d.s
        UNION ALL
        SELECT 3, row_number() OVER (ORDER BY a.s, b.s, c.s) - 1, [a.s, b.s, c.s]
        FROM slots a, slots b, slots c
        WHERE a.s < 4 AND b.s < 4 AND c.s < 4 AND a.s <> b.s AND a.s <> c.s AND b.s <> c.s""",
    "questions": """
        SELECT example_id, 0 AS tn, 'CTR' AS task, 3 AS k,
          list_transform(list_append(type_wrong, type_correct), lambda x: x = type_correct) AS same FROM exs
        UNION ALL SELECT example_id, 1, 'CLE', 4,
          list_transform(list_append(loc_wrong_easy, loc_correct), lambda x: x = loc_correct) FROM exs
        UNION ALL SELECT example_id, 2, 'CLH', 4,
          list_transform(list_append(loc_wrong_hard, loc_correct), lambda x: x = loc_correct) FROM exs
        UNION ALL SELECT example_id, 3, 'SIE', 4,
          list_transform(list_append(solution_wrong_easy, solution_correct), lambda x: x = solution_correct)
          FROM exs WHERE type_correct <> 'remove_only'
        UNION ALL SELECT example_id, 4, 'SIH', 4,
          list_transform(list_append(solution_wrong_hard, solution_correct), lambda x: x = solution_correct)
          FROM exs WHERE type_correct <> 'remove_only'""",
    "rights": """
        SELECT example_id, task, tn, q.k, p,
          CASE WHEN same[o[1]] THEN 'A' WHEN same[o[2]] THEN 'B' WHEN same[o[3]] THEN 'C' ELSE 'D' END AS sym
        FROM questions q JOIN orders r ON q.k = r.k""",
    "attempts": """
        SELECT doc_id AS example_id, unnest(CASE WHEN doc_id % 7 = 0 THEN [0, 1] ELSE [1] END) AS attempt
        FROM documents""",
    "gens": f"""
        SELECT model, condition, e.example_id, attempt,
          CASE WHEN attempt = 0 THEN '1 stale' ELSE CASE (e.example_id * 7 + m + c * 3) % 8
            WHEN 0 THEN num
            WHEN 1 THEN '```python' || {NL} || num || {NL} || '```'
            WHEN 2 THEN '[code]' || {NL} || num || {NL} || '[/code]'
            WHEN 3 THEN '```' || {NL} || '[code]' || {NL} || num || {NL} || '[/code]' || {NL} || '```' || {NL}
            WHEN 4 THEN replace(num, ' ', '  ') WHEN 5 THEN 'Here it is' || {NL} || num
            WHEN 6 THEN review ELSE '' END END AS content
        FROM (SELECT example_id, review, {_numbered('new')} AS num FROM exs) e
        JOIN attempts a ON a.example_id = e.example_id, models, conditions""",
    "last_gens": """
        SELECT * FROM gens
        QUALIFY row_number() OVER (PARTITION BY model, condition, example_id ORDER BY attempt DESC) = 1""",
    "texts": f"""
        SELECT model, condition, g.example_id, lang, type_correct,
          {_cut(_cleaned('content'), 2)} AS pred, {_cut('new', 1)} AS gold
        FROM last_gens g JOIN exs e ON e.example_id = g.example_id""",
    "asked": """
        SELECT model, condition, task, r.example_id, p AS perm_idx, k, sym, attempt,
          CASE WHEN (r.example_id + c) % 3 = 0 AND NOT (m = 1 AND p = 5) THEN 0
            ELSE (r.example_id * 31 + p * 17 + m * 7 + c * 3 + tn) % 24 END AS h
        FROM rights r JOIN attempts a ON a.example_id = r.example_id, models, conditions""",
    "given": f"""
        SELECT *,
          CASE WHEN attempt = 0 THEN '{{"answer": "A"}}' WHEN h = 12 THEN '' WHEN h = 13 THEN '{{"answer":'
            WHEN h = 20 THEN '{{"answer": "' || sym || '"}} x' WHEN h = 21 THEN ' ' || {NL} || ' '
            ELSE '{{"answer": "' || sym || '"}}' END AS content,
          CASE WHEN attempt = 0 THEN [{{'token': 'A', 'logprob': -0.05::DOUBLE}}]
            WHEN h = 14 THEN [{{'token': '{{', 'logprob': -0.1::DOUBLE}}]
            WHEN h = 15 THEN [{{'token': sym, 'logprob': -1.5::DOUBLE}}, {{'token': ' A', 'logprob': -0.2::DOUBLE}}]
            WHEN h = 16 THEN [{{'token': sym, 'logprob': -0.1::DOUBLE}}, {{'token': sym, 'logprob': -5.0::DOUBLE}},
                              {{'token': 'A', 'logprob': -3.0::DOUBLE}}]
            WHEN h = 17 THEN [{{'token': 'C', 'logprob': -1.0::DOUBLE}}, {{'token': 'B', 'logprob': -1.0::DOUBLE}}]
            WHEN h IN (18, 19) THEN [{{'token': substring('ABCD', (perm_idx % k + 1)::BIGINT, 1), 'logprob': -0.3::DOUBLE}}]
            WHEN h = 22 THEN NULL
            WHEN h = 23 THEN [{{'token': {NL} || sym || ' ', 'logprob': -0.4::DOUBLE}}]
            ELSE [{{'token': sym, 'logprob': -0.1::DOUBLE}}] END AS logprobs
        FROM asked""",
    "seen": f"""
        SELECT *, {_last_score('A')} AS sa, {_last_score('B')} AS sb, {_last_score('C')} AS sc,
          {_last_score('D')} AS sd,
          trim(content, ' ' || {NL}) <> '' AND json_valid(trim(content, ' ' || {NL})) AS usable
        FROM given""",
    "scored": f"""
        SELECT *, CASE WHEN usable THEN sa ELSE {v.FALLBACK_LOGPROB}::DOUBLE END AS score_a,
          CASE WHEN usable THEN sb ELSE {v.UNSEEN_LOGPROB}::DOUBLE END AS score_b,
          CASE WHEN usable THEN sc ELSE {v.UNSEEN_LOGPROB}::DOUBLE END AS score_c,
          CASE WHEN usable THEN sd ELSE {v.UNSEEN_LOGPROB}::DOUBLE END AS score_d
        FROM seen""",
    "picks": f"""
        SELECT {CELL}, example_id, perm_idx, k, sym, attempt,
          CASE WHEN score_a >= greatest(score_b, score_c, score_d) THEN 'A'
            WHEN score_b >= greatest(score_c, score_d) THEN 'B'
            WHEN score_c >= score_d OR k = 3 THEN 'C' ELSE 'D' END AS picked
        FROM scored""",
    "last_picks": f"""
        SELECT * FROM picks
        QUALIFY row_number() OVER (PARTITION BY {CELL}, example_id, perm_idx ORDER BY attempt DESC) = 1""",
    "tallies": f"""
        SELECT {CELL}, example_id, count(*) AS orderings, count(*) FILTER (picked = sym) AS matches,
          string_agg(picked, '' ORDER BY perm_idx) AS model_answers,
          string_agg(sym, '' ORDER BY perm_idx) AS correct_answers
        FROM last_picks GROUP BY ALL""",
    "choice_scores": f"""
        SELECT {CELL}, count(*) AS n, count(*) FILTER (matches = orderings) AS invariant,
          avg(matches) AS avg_correct, max(orderings)::INT AS orderings,
          count(*) FILTER (matches = orderings) / count(*) * 100 AS value
        FROM tallies GROUP BY ALL""",
    "spaced": f"""
        SELECT model, condition, example_id, lang, type_correct,
          ({_words('gold')} = {_words('pred')})::INT AS em FROM texts""",
    "loose": f"""
        SELECT t.*, {_hit_offsets('gq', 'pq', 'po')} AS em_no_space FROM (
          SELECT *, {_squash('gold')} AS gq, {_squash('pred')} AS pq,
            {_offsets(f"list_transform(string_split(pred, {NL}), lambda x: {_squash('x')})")} AS po
          FROM texts) t""",
    "acr": """
        SELECT model, condition, 'ACR' AS task, sum(em) / count(*) * 100 AS value, count(*) AS n
        FROM spaced GROUP BY ALL""",
    "results": f"""
        SELECT {CELL}, value, n FROM acr
        UNION ALL SELECT {CELL}, value, n FROM choice_scores""",
    "first_batch": f"""
        SELECT model, condition, 'ACR' AS task, sum(em_no_space) / count(*) * 100 AS value, count(*) AS n
        FROM loose GROUP BY ALL
        UNION ALL SELECT {CELL}, value, n FROM choice_scores WHERE task = 'CTR'""",
    "second_batch": f"""
        SELECT {CELL}, value, n FROM acr
        UNION ALL SELECT {CELL}, value, n FROM choice_scores WHERE task = 'CLE'""",
    "merged": f"""
        SELECT {CELL}, coalesce(s.value, f.value) AS value, coalesce(s.n, f.n) AS n
        FROM first_batch f FULL JOIN second_batch s USING ({CELL})""",
    "hits": f"""
        SELECT model, condition, 'ACR' AS task, example_id, lang, type_correct, em AS hit FROM spaced
        UNION ALL
        SELECT {CELL}, x.example_id, lang, type_correct, (matches = orderings)::INT
        FROM tallies x JOIN exs e ON e.example_id = x.example_id""",
    "requests": f"""
        SELECT *, {_filled(v.SUMMARY_REQUEST, {'old_code': 'old', 'new_code': 'new', 'review': 'review'})} AS prompt
        FROM exs""",
    "summaries": f"""
        SELECT example_id, CASE WHEN length(prompt) % 10 = 3
          THEN '{v.SUMMARY_ERROR_PREFIX}refused ' || length(prompt)
          ELSE length(prompt) || ' at {v.SUMMARY_OPTIONS['temperature']}' END AS summary FROM requests""",
    "refine_prompts": f"""
        SELECT 'ACR' AS task, condition, example_id, {_prompt(v.REFINE_PROMPT)} AS prompt
        FROM numbered_exs, conditions""",
    "type_options": f"""
        SELECT *, list_transform(list_append(type_wrong, type_correct), lambda x: {PHRASE.format('x')}) AS shown
        FROM numbered_exs""",
    "type_prompts": f"""
        SELECT 'CTR' AS task, condition, example_id, p::INT AS perm_idx,
          {_prompt(v.CHANGE_TYPE_PROMPT, option_a='shown[o[1]]', option_b='shown[o[2]]', option_c='shown[o[3]]')} AS prompt
        FROM type_options, orders, conditions WHERE k = 3""",
    "location_options": f"""
        SELECT *, 'CLE' AS task, list_transform(list_append(loc_wrong_easy, loc_correct), lambda x: {_ids_text('x')}) AS shown
        FROM numbered_exs
        UNION ALL
        SELECT *, 'CLH', list_transform(list_append(loc_wrong_hard, loc_correct), lambda x: {_ids_text('x')})
        FROM numbered_exs""",
    "location_prompts": f"""
        SELECT task, condition, example_id, p::INT AS perm_idx,
          {_prompt(v.LOCATION_PROMPT, **{f'option_{x}': f'shown[o[{i}]]' for i, x in enumerate('abcd', 1)})} AS prompt
        FROM location_options, orders, conditions WHERE k = 4""",
    "solution_options": f"""
        SELECT *, 'SIE' AS task, list_append(solution_wrong_easy, solution_correct) AS shown
        FROM numbered_exs WHERE type_correct <> 'remove_only'
        UNION ALL
        SELECT *, 'SIH', list_append(solution_wrong_hard, solution_correct)
        FROM numbered_exs WHERE type_correct <> 'remove_only'""",
    "solution_prompts": f"""
        SELECT task, condition, example_id, p::INT AS perm_idx,
          {_prompt(v.SOLUTION_PROMPT, **{f'option_{x}': f'{NL} || shown[o[{i}]]' for i, x in enumerate('abcd', 1)})} AS prompt
        FROM solution_options, orders, conditions WHERE k = 4""",
    "all_options": f"""
        SELECT example_id, 'CTR' AS task, 3 AS k, list_append(type_wrong, type_correct) AS opts FROM exs
        UNION ALL SELECT example_id, 'CLE', 4,
          list_transform(list_append(loc_wrong_easy, loc_correct), lambda x: {_ids_text('x')}) FROM exs
        UNION ALL SELECT example_id, 'CLH', 4,
          list_transform(list_append(loc_wrong_hard, loc_correct), lambda x: {_ids_text('x')}) FROM exs
        UNION ALL SELECT example_id, 'SIE', 4, list_append(solution_wrong_easy, solution_correct)
          FROM exs WHERE type_correct <> 'remove_only'
        UNION ALL SELECT example_id, 'SIH', 4, list_append(solution_wrong_hard, solution_correct)
          FROM exs WHERE type_correct <> 'remove_only'""",
    "uneven": """
        SELECT lang, CASE lang WHEN 'fr' THEN 3 WHEN 'de' THEN 5 ELSE 4 END AS easy, type_correct FROM exs""",
    "shares": """
        SELECT doc_id, length(text) / max(length(text)) OVER (PARTITION BY lang) * 100 AS share FROM documents""",
}


def _sql(body: str) -> str:
    """The query with the parts it needs, in the order they are defined."""
    needed: set[str] = set()
    open_texts = [body]
    while open_texts:
        text = open_texts.pop()
        for name, part in PARTS.items():
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                open_texts.append(part)
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed)
    return f"WITH {parts}\n{body}" if parts else body


def _pivot(source: str, shown: str) -> str:
    cells = ", ".join(
        f"{shown.format(f'max(value) FILTER (task = {_text(t)})')} AS {t}" for t in v.TASKS
    )
    return f"SELECT model, condition, {cells} FROM {source} GROUP BY model, condition"


def _fingerprint(source: str) -> str:
    return f"""
        SELECT example_id, md5(old) AS old_md5, md5(new) AS new_md5, md5(review) AS review_md5, lang, type_correct,
          array_to_string(type_wrong, '|') AS type_wrong, {_lists_text('loc_wrong_easy')} AS loc_wrong_easy,
          {_ids_text('loc_correct')} AS loc_correct, {_lists_text('loc_wrong_hard')} AS loc_wrong_hard,
          md5(solution_correct) AS solution_correct_md5,
          md5(array_to_string(solution_wrong_easy, '|')) AS solution_wrong_easy_md5,
          md5(array_to_string(solution_wrong_hard, '|')) AS solution_wrong_hard_md5,
          md5(coalesce(summary, 'none')) AS summary_md5 FROM {source}"""


def _patterns(a: str, b: str, c: str, d: str) -> str:
    return f"""
        SELECT task, {a} AS score_a, {b} AS score_b, {c} AS score_c, {d} AS score_d,
          count(*) AS n, sum(example_id)::BIGINT AS id_sum FROM scored GROUP BY ALL"""


def _answers(prompts: str, k: int) -> str:
    letter = f"substring('ABCD', (length(prompt) % {k} + 1)::BIGINT, 1)"
    return f"""
        SELECT task, condition, example_id, perm_idx, '{{"answer": "' || {letter} || '"}}' AS content,
          {letter} AS picked, -(length(prompt) % 7) / 8 AS score FROM {prompts}"""


def _invariant(tasks: str) -> str:
    return f"""
        SELECT {CELL}, n, invariant, round(value, 6) AS value, round(avg_correct, 6) AS avg_correct, orderings
        FROM choice_scores WHERE task IN ({tasks})"""


ROUND = "round({0}, 6)"
ROWS = f"SELECT {CELL}, round(value, 6) AS value, n FROM "
EM = f"({_words('gold')} = {_words('pred')})::INT"
TRIM_FROM = f"""
    (SELECT *, {_words('gold')} AS gw, {_words('pred')} AS pw,
      {_offsets(f'string_split(pred, {NL})')} AS po FROM pairs)"""
EM_TRIM = (
    "(len(list_filter(po, lambda j: j + len(gw) <= len(pw) AND pw[j + 1 : j + len(gw)] = gw)) > 0)::INT"
)
SPACE_FROM = f"""
    (SELECT *, {_squash('gold')} AS gq, {_squash('pred')} AS pq,
      {_offsets(f"list_transform(string_split(pred, {NL}), lambda x: {_squash('x')})")} AS qo FROM pairs)"""
BARE_FROM = f"""
    (SELECT *, {_squash('gold')} AS gq, {_squash('pred')} AS pq,
      {_offsets(f"list_transform(string_split(pred, {NL}), lambda x: {_squash('x')})")} AS qo
     FROM (SELECT doc_id, {_bare('gold')} AS gold, {_bare('pred')} AS pred FROM pairs))"""
EM_SPACE = _hit_offsets("gq", "pq", "qo")
PERCENTS = ", ".join(
    f"round(sum({m}) / count(*) * 100, 6) AS {m}_pct"
    for m in ("em", "em_trim", "em_no_space", "em_no_comment")
)


def _all_metrics(source: str, key: str) -> str:
    """Rows of the source with the four metrics."""

    def squashed_lines(x: str) -> str:
        return f"list_transform(string_split({x}, {NL}), lambda x: {_squash('x')})"

    return f"""
      SELECT {key}, (gw = pw)::INT AS em, {EM_TRIM} AS em_trim, {_hit_offsets('gq', 'pq', 'qo')} AS em_no_space,
        {_hit_offsets('bgq', 'bpq', 'bo')} AS em_no_comment
      FROM (SELECT *, {_words('gold')} AS gw, {_words('pred')} AS pw, {_offsets(f'string_split(pred, {NL})')} AS po,
          {_squash('gold')} AS gq, {_squash('pred')} AS pq, {_offsets(squashed_lines('pred'))} AS qo,
          {_squash('bgold')} AS bgq, {_squash('bpred')} AS bpq, {_offsets(squashed_lines('bpred'))} AS bo
        FROM (SELECT *, {_bare('gold')} AS bgold, {_bare('pred')} AS bpred FROM {source}))"""


def _tokens(x: str) -> str:
    return f"list_distinct(list_concat({_words(x)}, regexp_extract_all({x}, '[a-zA-Z]+')))"


BODIES = {
    "read_examples": _fingerprint("exs"),
    "read_examples_array": _fingerprint("exs"),
    "read_benchmark_split": """
        SELECT CASE WHEN lang = 'en' THEN 'Other' ELSE 'Benchmark' END AS split, lang, count(*) AS n,
          sum(length(new))::BIGINT AS chars FROM exs GROUP BY ALL""",
    "write_enriched": _fingerprint("(SELECT e.* REPLACE (s.summary AS summary) FROM exs e JOIN summaries s USING (example_id))"),
    "read_results": ROWS + "merged",
    "write_results_csv": """
        SELECT model, condition, task, round(value, 2) AS value FROM results WHERE condition = 'summary'""",
    "final_report": _pivot("results", "round({0}, 2)"),
    "filter_lang": """
        SELECT 'all' AS asked, example_id, lang FROM exs UNION ALL
        SELECT CASE lang WHEN 'en' THEN 'EN' WHEN 'de' THEN 'De' ELSE lang END, example_id, lang
        FROM exs WHERE lang IN ('en', 'fr', 'de', 'es')""",
    "eligible_for_task": """
        SELECT task, type_correct, count(*) AS n
        FROM exs, (SELECT unnest(['ACR', 'CTR', 'CLE', 'CLH', 'SIE', 'SIH']) AS task)
        WHERE task NOT LIKE 'SI%' OR type_correct <> 'remove_only' GROUP BY ALL""",
    "with_summary_condition": f"""
        SELECT example_id, condition, md5(CASE WHEN condition = 'summary'
          THEN {_filled(v.SUMMARY_SECTION, {'summary': "coalesce(summary, '')"})} ELSE '' END) AS section_md5
        FROM exs, conditions""",
    "language_label": f"""
        SELECT example_id, asked, md5({_prompt(v.REFINE_PROMPT, lang='label')}) AS prompt_md5
        FROM (SELECT *, 'plain' AS condition FROM numbered_exs),
          (SELECT unnest(['none', 'Java']) AS asked, unnest(['{v.DEFAULT_LABEL}', 'Java']) AS label)""",
    "option_mode": f"""
        SELECT example_id, 'easy' AS mode, 'CLE' AS task, {_lists_text('loc_wrong_easy')} AS wrong FROM exs
        UNION ALL SELECT example_id, 'hard', 'CLH', {_lists_text('loc_wrong_hard')} FROM exs
        UNION ALL SELECT example_id, 'easy', 'SIE', md5(array_to_string(solution_wrong_easy, '|')) FROM exs
        UNION ALL SELECT example_id, 'hard', 'SIH', md5(array_to_string(solution_wrong_hard, '|')) FROM exs""",
    "task_code": """
        SELECT kind, mode, task, count(*) AS n FROM exs,
          (SELECT unnest(['location', 'location', 'solution', 'solution']) AS kind,
             unnest(['easy', 'hard', 'easy', 'hard']) AS mode, unnest(['CLE', 'CLH', 'SIE', 'SIH']) AS task)
        GROUP BY ALL""",
    "add_summary_column": """
        SELECT e.example_id, md5(new) AS new_md5, s.summary FROM exs e JOIN summaries s USING (example_id)""",
    "summary_default": "SELECT example_id, md5(coalesce(summary, '')) AS summary_md5 FROM exs",
    "summary_status": f"""
        SELECT lang, coalesce(summary LIKE '{v.SUMMARY_ERROR_PREFIX}%', FALSE) AS summary_failed, count(*) AS n
        FROM exs GROUP BY ALL""",
    "summary_prompt": "SELECT example_id, md5(prompt) AS prompt_md5 FROM requests",
    "refine_prompt": "SELECT task, condition, example_id, md5(prompt) AS prompt_md5 FROM refine_prompts",
    "change_type_prompt": """
        SELECT task, condition, example_id, perm_idx, md5(prompt) AS prompt_md5 FROM type_prompts""",
    "location_prompt": """
        SELECT task, condition, example_id, perm_idx, md5(prompt) AS prompt_md5 FROM location_prompts""",
    "solution_prompt": """
        SELECT task, condition, example_id, perm_idx, md5(prompt) AS prompt_md5 FROM solution_prompts""",
    "change_type_phrase": f"""
        SELECT type_correct, {PHRASE.format('type_correct')} AS phrase, count(*) AS n FROM exs GROUP BY ALL""",
    "latest_answers": """
        SELECT model, condition, example_id, md5(content) AS content_md5,
          1704067200 + example_id * 10 + attempt AS seconds FROM last_gens""",
    "attach_generations": """
        SELECT model, condition, example_id, md5(pred) AS generation_md5, md5(gold) AS gold_md5 FROM texts""",
    "attach_choice_answers": f"""
        SELECT {CELL}, perm_idx::INT AS perm_idx, picked, sym AS correct_symbol, count(*) AS n,
          sum(example_id)::BIGINT AS id_sum FROM last_picks GROUP BY ALL""",
    "pending_work": f"""
        SELECT {CELL} FROM models, conditions, (SELECT unnest(['ACR', 'CTR', 'CLE', 'CLH', 'SIE', 'SIH']) AS task)
        WHERE ({CELL}) NOT IN (SELECT ({CELL}) FROM choice_scores
          WHERE task IN ('CTR', 'CLE') AND (model = 'm0' OR condition = 'summary'))""",
    "upsert_results": ROWS + "merged",
    "compare_conditions": """
        SELECT model, task, round(max(value) FILTER (condition = 'plain'), 6) AS plain,
          round(max(value) FILTER (condition = 'summary'), 6) AS summary,
          round(max(value) FILTER (condition = 'summary') - max(value) FILTER (condition = 'plain'), 6) AS delta
        FROM results GROUP BY ALL""",
    "build_options": """
        SELECT example_id, task, CASE WHEN task LIKE 'SI%' THEN md5(array_to_string(opts, '|'))
          ELSE array_to_string(opts, '|') END AS options FROM all_options""",
    "all_orderings": """
        SELECT example_id, task, p::INT AS perm_idx,
          CASE WHEN task LIKE 'SI%' THEN md5(array_to_string(list_transform(o, lambda i: opts[i]), '|'))
            ELSE array_to_string(list_transform(o, lambda i: opts[i]), '|') END AS perm_options
        FROM all_options a JOIN orders r ON a.k = r.k""",
    "correct_symbol": """
        SELECT task, p::INT AS perm_idx, sym AS correct_symbol, count(*) AS n, sum(example_id)::BIGINT AS id_sum
        FROM rights GROUP BY ALL""",
    "answer_keys": """
        SELECT example_id, task, string_agg(sym, '' ORDER BY p) AS key FROM rights GROUP BY ALL""",
    "option_count_check": """
        SELECT task, lang, options::INT AS options, options = k AS accepted, count(*) AS n FROM (
          SELECT lang, 'CTR' AS task, 3 AS options, 3 AS k FROM uneven
          UNION ALL SELECT lang, 'CLE', easy, 4 FROM uneven
          UNION ALL SELECT lang, 'CLH', 4, 4 FROM uneven
          UNION ALL SELECT lang, 'SIE', 4, 4 FROM uneven WHERE type_correct <> 'remove_only'
          UNION ALL SELECT lang, 'SIH', 4, 4 FROM uneven WHERE type_correct <> 'remove_only') GROUP BY ALL""",
    "combinations": """
        SELECT example_id, task, md5(string_agg(arranged, ';' ORDER BY p)) AS combinations_md5 FROM (
          SELECT example_id, task, p, CASE WHEN task LIKE 'SI%' THEN md5(array_to_string(list_transform(o, lambda i: opts[i]), '|'))
            ELSE array_to_string(list_transform(o, lambda i: opts[i]), '|') END AS arranged
          FROM all_options a JOIN orders r ON a.k = r.k) GROUP BY ALL""",
    "clean_generation": f"""
        SELECT model, condition, example_id, md5({_cleaned('content')}) AS cleaned_md5 FROM last_gens""",
    "drop_line_numbers": f"""
        SELECT doc_id, md5({_cut(_numbered('text'), 2)}) AS text_md5, md5({_cut('text', 2)}) AS cut_md5
        FROM documents""",
    "symbol_scores": _patterns("sa", "sb", "sc", "sd"),
    "fallback_first_choice": _patterns("score_a", "score_b", "score_c", "score_d"),
    "pick_symbol": f"""
        SELECT {CELL}, perm_idx::INT AS perm_idx, picked, count(*) AS n, sum(example_id)::BIGINT AS id_sum
        FROM picks GROUP BY ALL""",
    "number_lines": f"SELECT example_id, md5({_numbered('old')}) AS numbered_md5 FROM exs",
    "strip_markers": f"SELECT example_id, md5({_cut('new', 1)}) AS gold_md5 FROM exs",
    "remove_comments": f"""
        SELECT doc_id, length(bare)::INT AS chars, md5(bare) AS bare_md5
        FROM (SELECT doc_id, {_bare('code')} AS bare FROM codes)""",
    "words": f"""
        SELECT doc_id, len(w)::INT AS words, md5(array_to_string(w, '|')) AS words_md5
        FROM (SELECT doc_id, {_words('pred')} AS w FROM pairs)""",
    "squash": f"SELECT doc_id, md5({_squash('pred')}) AS squashed_md5 FROM pairs",
    "line_offsets": f"""
        SELECT doc_id, pos::INT AS pos,
          coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
            AS line_offset
        FROM (SELECT doc_id, unnest(list_append(list_transform(string_split(text, {NL}), lambda l: length(l)), 0)) AS chars,
            generate_subscripts(list_append(string_split(text, {NL}), ''), 1) - 1 AS pos FROM documents)""",
    "em": f"SELECT doc_id, {EM} AS em FROM pairs",
    "em_trim": f"SELECT doc_id, {EM_TRIM} AS em_trim FROM {TRIM_FROM}",
    "em_no_space": f"SELECT doc_id, {EM_SPACE} AS em_no_space FROM {SPACE_FROM}",
    "em_no_comment": f"SELECT doc_id, {EM_SPACE} AS em_no_comment FROM {BARE_FROM}",
    "score_generation": _all_metrics("pairs", "doc_id"),
    "jaccard": f"""
        SELECT doc_id, CASE WHEN len(list_distinct(list_concat(g, p))) = 0 THEN 0.0::DOUBLE
          ELSE round(len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))), 6) END AS jaccard
        FROM (SELECT doc_id, {_tokens('gold')} AS g,
          {_tokens('pred')} AS p FROM pairs)""",
    "matching_answers": f"SELECT {CELL}, example_id, matches::INT AS matches FROM tallies",
    "orderings_by_position": f"SELECT {CELL}, example_id, model_answers, correct_answers FROM tallies",
    "choice_records": f"""
        SELECT {CELL}, s.example_id, e.type_correct AS ground_truth,
          string_agg(sym, '' ORDER BY perm_idx) AS correct_answers,
          string_agg(CASE WHEN score_a >= greatest(score_b, score_c, score_d) THEN 'A'
            WHEN score_b >= greatest(score_c, score_d) THEN 'B'
            WHEN score_c >= score_d OR k = 3 THEN 'C' ELSE 'D' END, '' ORDER BY perm_idx) AS model_answers,
          md5(string_agg(concat_ws(',', round(score_a * 1000000)::BIGINT, round(score_b * 1000000)::BIGINT,
            round(score_c * 1000000)::BIGINT, round(score_d * 1000000)::BIGINT), ',' ORDER BY perm_idx)) AS scores_md5
        FROM (SELECT * FROM scored
              QUALIFY row_number() OVER (PARTITION BY {CELL}, example_id, perm_idx ORDER BY attempt DESC) = 1) s
        JOIN exs e ON e.example_id = s.example_id GROUP BY ALL""",
    "refine_report": f"""
        SELECT model, condition, count(*) AS n, sum(em)::BIGINT AS em, sum(em_trim)::BIGINT AS em_trim,
          sum(em_no_space)::BIGINT AS em_no_space, sum(em_no_comment)::BIGINT AS em_no_comment, {PERCENTS}
        FROM ({_all_metrics('texts', 'model, condition')}) GROUP BY ALL""",
    "invariant_accuracy": f"SELECT {CELL}, n, invariant, round(value, 6) AS value FROM choice_scores",
    "invariant_change_type": _invariant("'CTR'"),
    "invariant_location": _invariant("'CLE', 'CLH'"),
    "invariant_solution": _invariant("'SIE', 'SIH'"),
    "avg_correct": f"SELECT {CELL}, n, round(avg_correct, 6) AS avg_correct, orderings FROM choice_scores",
    "round_score": """
        SELECT doc_id, (CASE
          WHEN share * 4 = round(share * 4) AND share * 2 <> round(share * 2) THEN round_even(share * 100, 0) / 100
          ELSE round(share, 2) END)::DOUBLE AS score FROM shares""",
    "results_pivot": _pivot("results", ROUND),
    "results_unpivot": f"SELECT {CELL}, round(value, 6) AS value FROM first_batch",
    "progress": f"""
        SELECT {CELL}, example_id, sum(hit) OVER w::BIGINT AS hits_so_far, count(*) OVER w AS rows_so_far
        FROM hits WINDOW w AS (PARTITION BY {CELL} ORDER BY example_id)""",
    "answer_positions": """
        SELECT task, sym AS correct_symbol, picked, count(*) AS n FROM last_picks GROUP BY ALL""",
    "by_ground_truth": f"""
        SELECT {CELL}, 'all' AS breakdown, NULL::VARCHAR AS part, count(*) AS n, sum(hit)::BIGINT AS hits,
          round(sum(hit) / count(*) * 100, 6) AS value FROM hits GROUP BY {CELL}
        UNION ALL SELECT {CELL}, 'type_correct', type_correct, count(*), sum(hit)::BIGINT,
          round(sum(hit) / count(*) * 100, 6) FROM hits GROUP BY {CELL}, type_correct
        UNION ALL SELECT {CELL}, 'lang', lang, count(*), sum(hit)::BIGINT,
          round(sum(hit) / count(*) * 100, 6) FROM hits GROUP BY {CELL}, lang""",
    "append_scores": ROWS + "results WHERE task IN ('ACR', 'CTR', 'SIE')",
    "evaluate": ROWS + "results",
    "infer_generate": f"""
        SELECT task, condition, example_id,
          md5(prompt) || ' {v.GENERATE_OPTIONS['max_tokens']} {v.GENERATE_OPTIONS['stop'][0]}' AS content,
          NULL::VARCHAR AS error FROM refine_prompts""",
    "infer_choice": _answers("type_prompts", 3),
    "infer_choice_batch": _answers("location_prompts", 4) + " UNION ALL " + _answers("solution_prompts", 4),
    "run_grid": f"""
        SELECT {CELL}, round(value, 6) AS value, n FROM (
          SELECT model, condition, 'ACR' AS task,
            CASE WHEN (m, c) = (0, 1) THEN 12.5
              ELSE 100 * count(*) FILTER ((m, c) = (1, 0) AND example_id % 3 = 0) / count(*) END AS value,
            CASE WHEN (m, c) = (0, 1) THEN 8 ELSE count(*) END AS n
          FROM exs, models, conditions GROUP BY m, c, model, condition
          UNION ALL
          SELECT model, a.condition, task, count(*) FILTER (hits = orderings) / count(*) * 100, count(*)
          FROM (SELECT model, m, i.task, i.condition, i.example_id, count(*) AS orderings,
                  count(*) FILTER (i.picked = r.sym OR (m = 1 AND i.condition = 'plain' AND i.task = 'CTR'
                    AND i.example_id % 2 = 0 AND i.perm_idx IN (2, 4))) AS hits
                FROM ({_answers("type_prompts", 3)} UNION ALL {_answers("location_prompts", 4)}
                  UNION ALL {_answers("solution_prompts", 4)}) i
                JOIN rights r ON r.task = i.task AND r.example_id = i.example_id AND r.p = i.perm_idx, models
                GROUP BY ALL) a
          GROUP BY ALL)""",
    "rejects": """
        SELECT 'examples' AS step, 'null_gold' AS reason, count(*) FILTER (example_id % 13 = 0) AS n FROM exs
        UNION ALL SELECT 'examples', 'option_count_' || task, count(*) FILTER (
            (task = 'CLE' AND lang = 'fr') OR (task = 'SIH' AND type_correct <> 'remove_only' AND example_id % 11 = 0))
          FROM exs, (SELECT unnest(['CTR', 'CLE', 'CLH', 'SIE', 'SIH']) AS task) GROUP BY task
        UNION ALL SELECT 'choices', 'unplaced', count(*) FILTER (a.example_id % 19 = 0 OR a.example_id % 23 = 0
            OR (task = 'CLE' AND lang = 'fr') OR (task = 'SIH' AND a.example_id % 11 = 0))
          FROM asked a JOIN exs e ON e.example_id = a.example_id
        UNION ALL SELECT 'prompts', 'null_old', count(*) FILTER (example_id % 34 = 1) FROM exs
        UNION ALL SELECT 'prompts', 'null_review', count(*) FILTER (example_id % 17 = 0) FROM exs""",
    "infer_summary": "SELECT example_id, summary FROM summaries",
    "stream_scores": f"""
        SELECT model, condition, 'ACR' AS task, count(*) AS n, sum(em)::BIGINT AS hits FROM spaced GROUP BY ALL
        UNION ALL SELECT {CELL}, n, invariant FROM choice_scores""",
}

ORACLE = {name: _sql(body) for name, body in BODIES.items()}
