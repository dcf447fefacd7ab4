-- Findings of information leakage, with the flow they rest on, read back from the triples of matches {matches} (s, p, o).
-- Relations: {use}, {produce}, {plays}, {contains} as (s, o); {roles} and {categories} as (sub, super), reflexive.
-- Parameters: :rp, :pat and :generated bases.
WITH matched AS (SELECT s AS match FROM {matches} WHERE p = concat(:rp, 'matchesMotif') AND o = concat(:pat, 'VectorBasedInformationRetrievalMotif')),
held AS (
  SELECT m.match, substring_index(n.o, '#', -1) AS node, e.o AS element
  FROM matched m
    JOIN {matches} b ON b.s = m.match AND b.p = concat(:rp, 'hasNodeBinding')
    JOIN {matches} n ON n.s = b.o AND n.p = concat(:rp, 'bindsPatternNode')
    JOIN {matches} e ON e.s = b.o AND e.p = concat(:rp, 'matchedElement')),
role_of AS (SELECT DISTINCT p.s, r.super AS role FROM {plays} p JOIN {roles} r ON r.sub = p.o),
sensitive AS (SELECT DISTINCT k.s FROM {contains} k JOIN {categories} c ON c.sub = k.o AND c.super = 'SensitiveInformation'),
facing AS (SELECT s FROM role_of WHERE role = 'UserFacingOutput'),
generation AS (SELECT s FROM role_of WHERE role = 'GenerationStep'),
direct AS (SELECT DISTINCT u.o AS s FROM {use} u JOIN {produce} p ON p.s = u.s WHERE p.o IN (SELECT s FROM facing) AND u.s IN (SELECT s FROM generation)),
further AS (SELECT DISTINCT u.o AS s FROM {use} u JOIN {produce} p ON p.s = u.s WHERE p.o IN (SELECT s FROM direct)),
exposed AS (SELECT s, 0 AS hops FROM facing UNION SELECT s, 1 FROM direct UNION SELECT s, 2 FROM further)
SELECT concat(:generated, 'risk-finding/', replace(replace(replace(url_encode(st.match), '+', '%20'), '*', '%2A'), '%7E', '~'), '-information-leakage') AS finding_iri,
  st.match AS match_iri, st.element AS step, so.element AS source, re.element AS result, array_join(array_sort(collect_set(string(x.hops))), ',') AS hops
FROM held st
  JOIN held so ON so.match = st.match AND so.node = 'VectorIR_VectorStoreNode'
  JOIN held re ON re.match = st.match AND re.node = 'VectorIR_RetrievedResultNode'
  JOIN exposed x ON x.s = re.element
WHERE st.node = 'VectorIR_RetrievalStepNode' AND so.element IN (SELECT s FROM sensitive)
GROUP BY st.match, st.element, so.element, re.element
