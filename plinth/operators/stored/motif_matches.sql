-- Matches of the retrieval motifs as triples. Relations: {use}, {produce}, {plays} as (s, o); {roles} as (sub, super), reflexive.
-- Parameters: :core, :rp, :pat, :generated bases, :type and :label predicates.
WITH motif AS (
  SELECT * FROM VALUES
    ('VectorBasedInformationRetrievalMotif', 'Vector-based information retrieval motif match', '-vector-ir', 'RetrievalStep', 'VectorStore', 'RetrievedContext',
     'VectorIR_RetrievalStepNode', 'VectorIR_QueryNode', 'VectorIR_VectorStoreNode', 'VectorIR_RetrievedResultNode'),
    ('LLMBasedInformationRetrievalMotif', 'LLM-based information retrieval motif match', '-llm-ir', 'LLMBasedInformationRetrievalStep', 'GenerativeModel', 'UserFacingOutput',
     'LLMIR_RetrievalStepNode', 'LLMIR_QueryNode', 'LLMIR_ModelNode', 'LLMIR_AnswerNode')
    AS m(motif, label, suffix, step_role, source_role, result_role, step_node, query_node, source_node, result_node)),
role_of AS (SELECT DISTINCT p.s, r.super AS role FROM {plays} p JOIN {roles} r ON r.sub = p.o),
solved AS (
  SELECT m.*, concat(:generated, 'motif-match/', replace(replace(replace(url_encode(u.s), '+', '%20'), '*', '%2A'), '%7E', '~'), m.suffix) AS match, u.s AS step, u.o AS query, v.o AS source, w.o AS result
  FROM motif m
    JOIN role_of a ON a.role = m.step_role
    JOIN {use} u ON u.s = a.s JOIN role_of b ON b.s = u.o AND b.role = 'UserInput'
    JOIN {use} v ON v.s = a.s JOIN role_of c ON c.s = v.o AND c.role = m.source_role
    JOIN {produce} w ON w.s = a.s JOIN role_of d ON d.s = w.o AND d.role = m.result_role
  WHERE NOT startswith(u.s, '_:')),
bound AS (
  SELECT DISTINCT motif, label, match, concat(match, '/binding/', b.path) AS binding, b.node, b.element
  FROM solved LATERAL VIEW explode(array(
    named_struct('path', 'retrieval-step', 'node', step_node, 'element', step), named_struct('path', 'query', 'node', query_node, 'element', query),
    named_struct('path', 'source-or-model', 'node', source_node, 'element', source), named_struct('path', 'result', 'node', result_node, 'element', result))) x AS b)
SELECT DISTINCT t.s, t.p, t.o FROM bound LATERAL VIEW explode(array(
  named_struct('s', match, 'p', :type, 'o', concat(:rp, 'MotifMatch')), named_struct('s', match, 'p', :label, 'o', label),
  named_struct('s', match, 'p', concat(:rp, 'matchesMotif'), 'o', concat(:pat, motif)), named_struct('s', match, 'p', concat(:rp, 'hasNodeBinding'), 'o', binding),
  named_struct('s', binding, 'p', :type, 'o', concat(:rp, 'NodeBinding')), named_struct('s', binding, 'p', concat(:rp, 'bindsPatternNode'), 'o', concat(:pat, node)),
  named_struct('s', binding, 'p', concat(:rp, 'matchedElement'), 'o', element))) x AS t
