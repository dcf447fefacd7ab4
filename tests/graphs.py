"""Small architecture graphs in Turtle, of our own making, shaped like real ones."""

PREFIXES = """
@prefix c: <http://example.org/core#> .
@prefix rp: <http://example.org/risk-pattern#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix : <http://example.org/shop#> .
rp:VectorStore rp:subRoleOf rp:KnowledgeSource .
rp:RetrievedResult rp:subRoleOf rp:RetrievedContext .
rp:GenerativeModel rp:subRoleOf rp:Model .
rp:VectorBasedRetrievalStep rp:subRoleOf rp:RetrievalStep .
rp:LLMBasedInformationRetrievalStep rp:subRoleOf rp:RetrievalStep .
rp:SensitiveInformation rp:subDataCategoryOf rp:Information .
rp:PersonalInformation rp:subDataCategoryOf rp:SensitiveInformation .
:PrivatePrices rp:subDataCategoryOf rp:ProductInformation, rp:SensitiveInformation .
"""
#: Retrieval, then an intermediate step, then a generation step with user-facing output: exposed over two hops.
TWO_HOPS = PREFIXES + """
:retrieve a c:Transform ; rp:playsRole rp:RetrievalStep ; c:use :question , :store , :plain ; c:produce :context .
:question rp:playsRole rp:UserInput .   # the only query
:store rp:playsRole rp:KnowledgeSource, rp:VectorStore ; rp:containsDataCategory :PrivatePrices .
:context rp:playsRole rp:RetrievedContext , rp:RetrievedResult .
:rerank rp:playsRole rp:Reranking ; c:use :context ; c:produce :better .
:prompt rp:playsRole rp:GenerationStep ; c:use :better ; c:produce :summary .
:summary rp:playsRole rp:UserFacingOutput .
"""
LLM = PREFIXES + """
:ask rp:playsRole rp:LLMBasedInformationRetrievalStep ; c:use :question , :model ; c:produce :answer .
:question rp:playsRole rp:UserInput . :model rp:playsRole rp:GenerativeModel . :answer rp:playsRole rp:UserFacingOutput .
"""
