"""Course tables derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

COURSES_RAW = """
SELECT p_partkey AS nseq, p_brand AS university,
  CASE p_partkey % 4 WHEN 0 THEN concat('CSE', n) WHEN 1 THEN concat('MATH-', n) WHEN 2 THEN concat('PHYS  ', n, 'Q') ELSE concat('Invalid-', n) END AS course_id,
  p_name AS title,
  CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE concat('About ', p_name, ' &amp; more , in the Department of ', p_type, '. Size ', cast(p_size AS string), '.') END AS description,
  CASE p_size % 6 WHEN 0 THEN '3 credits' WHEN 1 THEN '3-4 credits' WHEN 2 THEN 'Lecture (4)' WHEN 3 THEN 'credits vary' WHEN 4 THEN 'none listed' ELSE '3.5 cr.' END AS credits_text,
  p_type AS department,
  CASE p_partkey % 10 WHEN 0 THEN 'CSE 1010 and CSE-1729' WHEN 1 THEN 'MATH 1131Q or MATH1151Q' WHEN 2 THEN 'CSE 2100 and (MATH 2210Q or MATH 2410Q)'
    WHEN 3 THEN '(CSE 1010 or CSE 1020) and (MATH 1131 or MATH 1132)' WHEN 4 THEN 'CSE 1010 and CSE 1729 or MATH 2210Q' WHEN 5 THEN 'Permission of Instructor required'
    WHEN 6 THEN '   ' WHEN 7 THEN NULL WHEN 8 THEN 'CSE 1010 (grade of C or better)' ELSE 'CSE 1010 or 1729. Corequisites: PHYS 1401Q, CSE 3000; open only to majors' END AS prerequisites_text,
  CASE WHEN p_partkey % 13 = 0 THEN 'old note' END AS notes
FROM (SELECT part.*, cast(1000 + (p_partkey * 7) % 60 * 100 AS string) AS n FROM part) AS p
"""

GOLDEN_CHANGES = """
SELECT nseq, university, course_id, concat('  ', upper(title), ' ') AS title, CASE WHEN nseq % 7 = 0 THEN NULL ELSE description END AS description, credits_text,
  CASE WHEN nseq % 15 = 0 THEN concat(department, ' X') ELSE department END AS department, prerequisites_text
FROM courses_raw WHERE nseq % 5 = 0
"""

SNAPSHOTS = """
SELECT concat('U', cast(user_id AS string)) AS university, concat('https://example.org/', cast(user_id AS string)) AS url, min(event_id) AS nseq, cast(sum(event_id) AS string) AS body,
  max(ts) AS last_checked, coalesce(max(CASE WHEN event_type = 'purchase' THEN ts END), min(ts)) AS last_updated, count(*) AS course_count
FROM events WHERE user_id % 10 <> 3 GROUP BY user_id
"""

CURRENT = """
SELECT concat('U', cast(user_id AS string)) AS university, concat('https://example.com/', cast(user_id AS string)) AS url, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'altered' ELSE cast(sum(event_id) AS string) END AS body
FROM events WHERE user_id % 11 <> 5 GROUP BY user_id
"""

RUN_EVENTS = """
SELECT concat('U', cast(user_id % 50 AS string)) AS university, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS courses, 1 AS pages,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, value AS memory_mb
FROM events
"""

NOW = "2024-01-31 00:00:00"
