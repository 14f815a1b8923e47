"""The derived tables as DuckDB common table expressions, for self-contained oracle statements."""

from __future__ import annotations

#: Each table's SQL and the tables that it needs.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "words": (
        r"""SELECT file_id, word_idx, turn, role, CASE WHEN file_id % 4 <> 1 THEN word WHEN word_idx = 0 AND file_id % 8 = 5 THEN '(unreadable)'
            WHEN word_idx = 0 AND file_id % 16 = 1 THEN '(absent)' ELSE coalesce(nullif(regexp_replace(word, '[.!?؟۔…]', '', 'g'), ''), 'mm') END AS word,
          word_idx * 0.5::DOUBLE AS start_s, word_idx * 0.5::DOUBLE + 0.25::DOUBLE AS end_s FROM (
          SELECT conv_id AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS word_idx, turn, role, word
          FROM (SELECT conv_id, turn, role, unnest(string_split_regex(trim(text), '\s+')) AS word,
            generate_subscripts(string_split_regex(trim(text), '\s+'), 1) AS pos FROM conversations))""",
        (),
    ),
    "segments": (
        """SELECT file_id, word_idx // 6 AS seg_idx, min(start_s) AS start_s, max(end_s) + 0.25::DOUBLE AS end_s,
          string_agg(word, ' ' ORDER BY word_idx) AS text, ((file_id * 31 + (word_idx // 6) * 7) % 11)::DOUBLE / 10::DOUBLE AS no_speech_prob
        FROM words GROUP BY file_id, word_idx // 6""",
        ("words",),
    ),
    "turn_segments": (
        """SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY turn, part) - 1 AS seg_idx, start_s, end_s, speaker, text FROM (
          SELECT file_id, turn, part, role AS speaker, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(word, ' ' ORDER BY word_idx) AS text
          FROM (SELECT *, (row_number() OVER (PARTITION BY file_id, turn ORDER BY word_idx) - 1) // 6 AS part FROM words) GROUP BY file_id, turn, part, role)""",
        ("words",),
    ),
    "turns": (
        """SELECT file_id, turn AS turn_idx, min(start_s) + 0.75::DOUBLE AS start_s, max(end_s) + 0.75::DOUBLE AS end_s,
          CASE role WHEN 'system' THEN 'SPEAKER_07' WHEN 'user' THEN 'SPEAKER_02' ELSE 'SPEAKER_00' END AS speaker
        FROM words WHERE turn % 5 <> 3 GROUP BY file_id, turn, role""",
        ("words",),
    ),
    "job_events": (
        """SELECT user_id AS owner_id, user_id * 100 + n // 11 AS job_id, n % 11 AS seq, ts,
          CASE WHEN n % 11 = 10 THEN CASE WHEN event_type = 'error' THEN 'job_failed' ELSE 'job_completed' END
               WHEN (n % 11) % 2 = 0 THEN 'stage_started' ELSE 'stage_completed' END AS event,
          CASE WHEN n % 11 < 10 THEN (n % 11) // 2 END AS stage_index,
          CASE WHEN n % 11 < 10 THEN ((n % 11) // 2 + (n % 11) % 2)::DOUBLE / 5::DOUBLE END AS progress
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)""",
        (),
    ),
    "jobs": (
        """SELECT owner_id, job_id, min(ts) AS created_at, 'clip_' || (job_id % 7) || '.wav' AS file_name,
          ['queued', 'running', 'completed', 'failed', 'interrupted', 'cancelled'][job_id % 6 + 1] AS status
        FROM job_events GROUP BY owner_id, job_id""",
        ("job_events",),
    ),
    "replies": (
        """SELECT doc_id AS file_id, doc_id % 6 AS kind, CASE doc_id % 6
          WHEN 0 THEN '{"hate_speech": ' || f || ', "category": "insult", "confidence": "high", "reason": "r' || doc_id || '"}'
          WHEN 1 THEN 'Answer: {"hate_speech": ' || f || ', "category": "threat", "confidence": "medium", "reason": "r' || doc_id || '"} end.'
          WHEN 2 THEN 'Answer: {"hate_speech": tru' WHEN 3 THEN 'no idea'
          WHEN 4 THEN '{"hate_speech": ' || f || ', "category": "insult", "confidence": "certain", "reason": "r' || doc_id || '"}'
          ELSE '{"hate_speech": ' || f || ', "category": "INSULT", "confidence": "HIGH", "reason": "r' || doc_id || '"}' END AS raw
        FROM (SELECT *, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS f FROM labels)""",
        (),
    ),
    "entity_replies": (
        r"""SELECT file_id, pos - 1 AS pos, text, ['person', 'place', 'org', 'date', 'event', 'work', 'law', 'group', 'other'][length(text) % 9 + 1] AS label,
          ((pos - 1) % 10)::DOUBLE / 10::DOUBLE AS score FROM (
          SELECT doc_id AS file_id, unnest(string_split_regex(text, '\s+')) AS text, generate_subscripts(string_split_regex(text, '\s+'), 1) AS pos FROM documents)
        WHERE regexp_matches(text, '^[A-Z][a-z]+$')""",
        (),
    ),
    "word_speakers": (
        """SELECT file_id, word_idx, arg_max(speaker, (total, -first_turn)) AS speaker FROM (
          SELECT w.file_id, w.word_idx, t.speaker, sum(least(w.end_s, t.end_s) - greatest(w.start_s, t.start_s)) AS total, min(t.turn_idx) AS first_turn
          FROM words w JOIN turns t ON w.file_id = t.file_id AND least(w.end_s, t.end_s) > greatest(w.start_s, t.start_s)
          GROUP BY ALL) GROUP BY ALL""",
        ("words", "turns"),
    ),
    "segment_speakers": (
        """SELECT file_id, seg_idx, arg_max(speaker, (total, -first_turn)) AS speaker FROM (
          SELECT s.file_id, s.seg_idx, t.speaker, sum(least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s)) AS total, min(t.turn_idx) AS first_turn
          FROM segments s JOIN turns t ON s.file_id = t.file_id AND least(s.end_s, t.end_s) > greatest(s.start_s, t.start_s)
          GROUP BY ALL) GROUP BY ALL""",
        ("segments", "turns"),
    ),
    "labelled_words": (
        "SELECT w.*, s.speaker FROM words w LEFT JOIN word_speakers s USING (file_id, word_idx)",
        ("words", "word_speakers"),
    ),
    "run_words": (
        """SELECT *, sum(cut) OVER (PARTITION BY file_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS run_idx FROM (
          SELECT *, CASE WHEN speaker IS NOT NULL AND before IS NOT NULL AND speaker <> before THEN 1 ELSE 0 END AS cut FROM (
            SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM labelled_words))""",
        ("labelled_words",),
    ),
    "split_segments": (
        """SELECT file_id, seg_idx, 0::BIGINT AS part, start_s, end_s, text, coalesce(one, seg.speaker) AS speaker FROM (
            SELECT s.*, p.one, coalesce(p.n, 0) AS n FROM segments s LEFT JOIN (
              SELECT file_id, seg_idx, count(DISTINCT speaker) AS n, min(speaker) AS one FROM in_segment GROUP BY ALL) p USING (file_id, seg_idx)) x
          LEFT JOIN segment_speakers seg USING (file_id, seg_idx) WHERE n <= 1
        UNION ALL
        SELECT file_id, seg_idx, part, min(start_s), max(end_s), string_agg(word, ' ' ORDER BY word_idx), max(speaker) FROM (
          SELECT *, sum(cut) OVER (PARTITION BY file_id, seg_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM (
            SELECT *, CASE WHEN speaker <> last_value(speaker IGNORE NULLS) OVER (PARTITION BY file_id, seg_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut
            FROM in_segment SEMI JOIN (SELECT file_id, seg_idx FROM in_segment GROUP BY ALL HAVING count(DISTINCT speaker) > 1) USING (file_id, seg_idx)))
        GROUP BY file_id, seg_idx, part""",
        ("segments", "in_segment", "segment_speakers"),
    ),
    "in_segment": (
        """SELECT w.file_id, s.seg_idx, w.word_idx, w.word, w.start_s, w.end_s, w.speaker FROM labelled_words w JOIN segments s
          ON w.file_id = s.file_id AND (w.start_s + w.end_s) / 2 >= s.start_s AND (w.start_s + w.end_s) / 2 < s.end_s""",
        ("labelled_words", "segments"),
    ),
    "filled_segments": (
        """SELECT s.file_id, s.seg_idx, s.part, s.start_s, s.end_s, s.text, coalesce(s.speaker, n.speaker) AS speaker FROM split_segments s LEFT JOIN (
          SELECT s.file_id, s.seg_idx, s.part, arg_min(t.speaker, (greatest(t.start_s - s.end_s, s.start_s - t.end_s, 0), CASE WHEN t.start_s > s.end_s THEN 1 ELSE 0 END, t.turn_idx)) AS speaker
          FROM split_segments s JOIN turns t USING (file_id) WHERE s.speaker IS NULL GROUP BY ALL) n USING (file_id, seg_idx, part)""",
        ("split_segments", "turns"),
    ),
    "named_segments": (
        """SELECT file_id, seg_idx, part, start_s, end_s, text, CASE WHEN speaker IS NOT NULL THEN 'Speaker ' || dense_rank() OVER (PARTITION BY file_id, speaker IS NULL ORDER BY first_at) END AS speaker FROM (
          SELECT *, min((seg_idx, part)) OVER (PARTITION BY file_id, speaker) AS first_at FROM filled_segments)""",
        ("filled_segments",),
    ),
    "transcript": (
        r"""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY sentence) - 1 AS row_idx, start_s, end_s, speaker, text FROM (
          SELECT file_id, sentence, min(start_s) AS start_s, arg_max(end_s, (seg_idx, part)) AS end_s, arg_min(speaker, (seg_idx, part)) AS speaker, string_agg(trim(text), ' ' ORDER BY seg_idx, part) AS text FROM (
            SELECT *, sum(cut) OVER (PARTITION BY file_id ORDER BY seg_idx, part ROWS UNBOUNDED PRECEDING) AS sentence FROM (
              SELECT *, CASE WHEN regexp_matches(lag(text) OVER o, '[.!?؟۔]\s*$') OR speaker IS DISTINCT FROM lag(speaker) OVER o THEN 1 ELSE 0 END AS cut
              FROM chosen_named WINDOW o AS (PARTITION BY file_id ORDER BY seg_idx, part)))
          GROUP BY file_id, sentence)""",
        ("chosen_named",),
    ),
    "restored_files": (
        r"""SELECT file_id FROM segments GROUP BY file_id
        HAVING sum(len(regexp_extract_all(text, '[.!?؟۔…]')))::DOUBLE / sum(len(regexp_extract_all(text, '\S+'))) < 0.01::DOUBLE AND count_if(contains(text, '(unreadable)')) = 0""",
        ("segments",),
    ),
    "restored_rows": (
        r"""SELECT file_id, run_idx::BIGINT AS seg_idx, sentence::BIGINT AS part, min(start_s) AS start_s, max(end_s) AS end_s,
          CASE WHEN regexp_matches(string_agg(word, ' ' ORDER BY place), '[.!?؟۔]$') THEN string_agg(word, ' ' ORDER BY place) ELSE string_agg(word, ' ' ORDER BY place) || '.' END AS text, max(label) AS speaker FROM (
          SELECT *, max(speaker) OVER (PARTITION BY file_id, run_idx) AS label,
            coalesce(count(mark) OVER (PARTITION BY file_id, run_idx ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM (
            SELECT *, CASE WHEN place % 400 = 399 OR place = total - 1 OR (NOT away AND place % 400 % 10 = 9) THEN '.' END AS mark FROM (
              SELECT *, bool_or(word = '(absent)') OVER (PARTITION BY file_id, run_idx, place // 400) AS away FROM (
                SELECT *, row_number() OVER (PARTITION BY file_id, run_idx ORDER BY word_idx) - 1 AS place, count(*) OVER (PARTITION BY file_id, run_idx) AS total
                FROM run_words SEMI JOIN restored_files USING (file_id)))))
        GROUP BY file_id, run_idx, sentence""",
        ("run_words", "restored_files"),
    ),
    "chosen_segments": (
        """SELECT file_id, seg_idx, part, start_s, end_s, text, speaker FROM split_segments ANTI JOIN restored_files USING (file_id)
        UNION ALL SELECT file_id, seg_idx, part, start_s, end_s, text, speaker FROM restored_rows""",
        ("split_segments", "restored_files", "restored_rows"),
    ),
}
#: The same steps on what the two branches of the transcript chose.
CTES["chosen_filled"] = (CTES["filled_segments"][0].replace("split_segments", "chosen_segments"), ("chosen_segments", "turns"))
CTES["chosen_named"] = (CTES["named_segments"][0].replace("filled_segments", "chosen_filled"), ("chosen_filled",))


def with_tables(sql: str, *needed: str) -> str:
    """A statement that defines the needed derived tables, and those that they need, before the given query."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][1]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + sql


#: A text's words, and their chunks of at most {budget} characters as lists of one string each.
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
_PACKED = "list_reduce(list_transform(w, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) + 1 + length(b[1]) <= {budget} THEN list_append(a[:-2], a[-1] || ' ' || b[1]) ELSE list_concat(a, b) END)"
_REPLY = "string_split(c, ' ')[1] || ' ' || string_split(c, ' ')[-1] || ' ' || len(string_split(c, ' '))"


def summary_tables(source: str, budget: int, depth: int = 5) -> str:
    """Common table expressions that fold a table (file_id, text) to `summaries` (file_id, summary): each round packs the texts
    to chunks, puts a chunk's first word, last word and number of words in its place, and joins these by blank lines."""
    made, before = [], source
    for k in range(depth + 1):
        some = "" if k == 0 else "WHERE n > 1"
        chunks = "chunks[1:1]" if k == depth else "chunks"
        made.append(f"""fold_{k} AS (SELECT file_id, len({chunks}) AS n, array_to_string(list_transform({chunks}, lambda c: {_REPLY}), chr(10) || chr(10)) AS text
  FROM (SELECT file_id, {_PACKED.format(budget=budget)} AS chunks FROM (SELECT file_id, {_WORDS} AS w FROM {before} {some})))""")
        before = f"fold_{k}"
    ends = " UNION ALL ".join(f"SELECT file_id, text AS summary FROM fold_{k} WHERE n = 1" for k in range(depth + 1))
    return ",\n".join(made) + f",\nsummaries AS ({ends})"
