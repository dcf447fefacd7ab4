"""Names of the graph vocabulary. Bases are parameters: pass those that your own graph files declare."""

from __future__ import annotations

from dataclasses import dataclass

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
DCT = "http://purl.org/dc/terms/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE, LABEL, DESCRIPTION = f"{RDF}type", f"{RDFS}label", f"{DCT}description"


@dataclass(frozen=True)
class Vocabulary:
    """core: architecture; pattern: roles, motifs, matches and findings; catalogue: the motifs themselves; generated: new IRIs."""

    core: str = "http://example.org/core#"
    pattern: str = "http://example.org/risk-pattern#"
    catalogue: str = "http://example.org/patterns#"
    generated: str = "http://example.org/generated/"
    taxonomies: tuple[tuple[str, str], ...] = (
        ("atlas", "http://example.org/taxonomy/atlas#"), ("owasp", "http://example.org/taxonomy/owasp-llm#"),
        ("mit", "http://example.org/taxonomy/mit#"), ("mitctrl", "http://example.org/taxonomy/mit-control#"),
    )

    def c(self, name: str) -> str:
        return self.core + name

    def p(self, name: str) -> str:
        return self.pattern + name

    def pat(self, name: str) -> str:
        return self.catalogue + name

    def entry(self, curie: str) -> str:
        prefix, name = curie.split(":", 1)
        return dict(self.taxonomies)[prefix] + name


#: Sub-role edges and sub-category edges of the shared hierarchies.
ROLE_EDGES = (
    ("VectorStore", "KnowledgeSource"), ("RetrievedResult", "RetrievedContext"), ("SystemPrompt", "PromptTemplate"), ("MLModel", "Model"),
    ("GenerativeModel", "Model"), ("ClassifierModel", "MLModel"), ("RegressionModel", "MLModel"), ("HumanOversightActor", "HumanActor"),
    ("AffectedStakeholder", "HumanActor"), ("VectorBasedRetrievalStep", "RetrievalStep"), ("LLMBasedInformationRetrievalStep", "RetrievalStep"),
)
CATEGORY_EDGES = (
    ("ProductInformation", "Information"), ("SensitiveInformation", "Information"), ("PromptInstruction", "Information"), ("UntrustedContent", "Information"),
    ("GeneratedContent", "Information"), ("TrainingData", "Information"), ("ValidationData", "Information"),
    ("PersonalInformation", "SensitiveInformation"), ("ConfidentialInformation", "SensitiveInformation"),
)
