"""Vocabularies, labels, patterns and thresholds that results depend on."""

# fixed values: relation types, in their groups, and their display labels
REL_LABELS = {
    "IS_A": "階層", "PART_OF": "組成", "CONTAINS": "包含", "INSTANCE_OF": "實例",
    "CAUSES": "因果", "PREVENTS": "阻止", "ENABLES": "賦能", "IMPROVES": "改善", "INHIBITS": "抑制",
    "USES": "使用", "REQUIRES": "需求", "PRODUCES": "產出", "IMPLEMENTS": "實作", "REPLACES": "取代", "EXTENDS": "延伸",
    "CONTRASTS": "對比", "SIMILAR_TO": "相似", "OUTPERFORMS": "優越",
    "DEFINED_AS": "定義", "HAS_PROPERTY": "屬性", "MEASURED_BY": "量測", "APPLIES_TO": "應用",
    "PRECEDES": "前置", "FOLLOWS": "後置", "CO_OCCURS": "共現",
    "INPUTS": "輸入", "TRANSFORMS": "轉換",
    "CREATED_BY": "歸屬", "SOLVES": "解決",
    "VIOLATES": "違反", "RELATED_TO": "相關",
}
REL_TYPES = tuple(REL_LABELS)
# fixed values: labels that remote shards show
REMOTE_LABELS = {
    "IS_A": "是", "PART_OF": "是...的一部分", "CONTAINS": "包含", "INSTANCE_OF": "是...的實例",
    "CAUSES": "導致", "PREVENTS": "防止", "ENABLES": "使能", "IMPROVES": "改善", "INHIBITS": "抑制",
    "USES": "使用", "REQUIRES": "需要", "PRODUCES": "產生", "IMPLEMENTS": "實作", "REPLACES": "取代", "EXTENDS": "擴展",
    "CONTRASTS": "對比", "SIMILAR_TO": "相似於", "OUTPERFORMS": "優於",
    "DEFINED_AS": "定義為", "HAS_PROPERTY": "具有屬性", "MEASURED_BY": "以...衡量", "APPLIES_TO": "適用於",
    "PRECEDES": "先於", "FOLLOWS": "後於", "CO_OCCURS": "共現", "INPUTS": "輸入", "TRANSFORMS": "轉換",
    "CREATED_BY": "由...創建", "SOLVES": "解決", "VIOLATES": "違反", "RELATED_TO": "相關於",
}
# fixed values: entity types and the node labels they get
TYPE_LABELS = {
    "概念": "Concept", "算法": "Algorithm", "技術": "Technology", "方法": "Method", "工具": "Tool", "框架": "Framework",
    "模型": "Model", "系統": "System", "人物": "Person", "組織": "Organization", "資料集": "Dataset", "指標": "Metric", "其他": "Other",
    "法規": "Regulation", "假期": "Holiday", "企業": "Enterprise", "政府機關": "GovernmentAgency", "限制數值": "LimitValue", "行為": "Behavior",
}
# fixed values: placeholders that are no entity or no verb, after strip and lower case
NULL_ENTITIES = ("空白", "無", "none", "n/a", "null", "")
NULL_VERBS = ("無明確關係", "動詞", "無", "none", "n/a", "null", "")
# fixed values: company suffixes and radicals of the name normalisation
COMPANY_SUFFIX = "(股份有限公司|有限公司|合夥|企業社|工作室|商行)$"
RADICALS = {"⿓": "龍", "⿣": "龍", "⾝": "門", "⼈": "人", "⾋": "魚", "⾌": "鳥", "⾔": "麥", "⾜": "黃"}
# fixed values: groups of equal terms, lower case
SYNONYMS = (
    ("強化學習", "reinforcement learning", "rl"), ("機器學習", "machine learning", "ml"), ("深度學習", "deep learning", "dl"), ("人工智慧", "artificial intelligence", "ai"),
    ("監督式學習", "supervised learning"), ("非監督式學習", "unsupervised learning"), ("遷移學習", "transfer learning"), ("微調", "fine-tuning", "fine tuning", "finetuning"),
    ("神經網路", "神經網絡", "neural network", "nn"), ("卷積神經網路", "cnn", "convolutional neural network"), ("遞迴神經網路", "rnn", "recurrent neural network"), ("變換器", "transformer"),
    ("注意力機制", "attention mechanism", "self-attention"), ("生成對抗網路", "gan", "generative adversarial network"), ("大型語言模型", "llm", "large language model"), ("擴散模型", "diffusion model"),
    ("自然語言處理", "nlp", "natural language processing"), ("詞嵌入", "word embedding", "word2vec"), ("檢索增強生成", "rag", "retrieval augmented generation", "retrieval-augmented generation"),
    ("向量資料庫", "vector database", "vector db", "vector store"), ("語意搜尋", "semantic search"), ("知識圖譜", "knowledge graph", "kg"), ("知識庫", "knowledge base", "kb"), ("本體論", "ontology"),
    ("實體", "entity"), ("關係抽取", "relation extraction", "re"), ("命名實體辨識", "ner", "named entity recognition"), ("電腦視覺", "computer vision", "cv"), ("目標偵測", "object detection"),
    ("影像辨識", "image recognition", "image classification"), ("應用程式介面", "api", "application programming interface"), ("資料庫", "database", "db"), ("容器化", "containerization", "docker"),
    ("微服務", "microservice", "microservices"), ("函式庫", "函數庫", "library", "lib"), ("框架", "framework"),
)
# fixed values: patterns
GLOBAL_QUESTION = r"(總結|整體|全部|總覽|概覽|綜覽|全域|整個知識庫|有哪些.{0,6}(領域|主題|類別|方向)|overview|summar(y|ize)|entire knowledge\s*base)"
NO_INFORMATION = "知識庫目前無此資訊|找不到相關|無法回答|沒有相關資訊"
ENUMERATION = r"(?m)^\s*(?:#{1,6}\s+)?(?:[①-⑩]|[1-9][0-9]?(?:[.)）]\s|、)|[•·▪▸]\s|第[一二三四五六七八九十百]+[章節項])"
READABLE = r"[\x00-\x7F一-鿿　-〿＀-￯⺀-⻿]"
CONFIDENCE_TAIL = r'(?s)\{"confidence":\s*([\d.]+)[^}]*\}\s*$'
# fixed values: sentence templates by relation label ({s} subject, {o} object)
SENTENCES = {
    "歸屬": "{s} 由 {o} 提出。", "階層": "{s} 屬於 {o}。", "組成": "{s} 的組成包含 {o}。", "包含": "{s} 包含 {o}。", "定義": "{s} 定義為：{o}。", "相關": "{s} 與 {o} 相關。", "因果": "{s} 導致 {o}。",
    "需求": "{s} 需要 {o}。", "優越": "{s} 優於 {o}。", "前置": "{o} 的前置條件是 {s}。", "延伸": "{s} 建構於 {o}。", "相似": "{s} 類似於 {o}。", "改善": "{s} 可提升 {o}。", "使用": "{s} 使用 {o}。",
}
# fixed values: numbers
SENTENCES_PER_CHUNK, MIN_SENTENCE = 5, 5
ROUTE_MIN, ROUTE_TOP, COARSE_K = 0.05, 5, 100
CLASSIFY_MIN, CLASSIFY_AUTO = 0.05, 0.30
DECAY_PER_DAY, FUSE_ALPHA = 0.005, 0.85
SEED_FACTS, FACT_DOCS, FACT_LIMIT, SEED_NEIGHBOURS, CHAINS = 20, 3, 50, 20, 10
COS_FLOOR, MATCH_COS, MATCH_TOP = 0.01, 0.7, 5
QUERY_WEIGHT, SEARCH_MIN = 0.8, 0.35
CLUSTER_COS, CLUSTER_MIN, CLUSTER_CONCEPTS = 0.35, 2, 15
RATE_LIMIT, RATE_WINDOW = 20, 60
ORPHANS_AT_ONCE = 5000
# fixed values: entity types that a graph without documents' concepts is routed by
ROUTING_TYPES = ("概念", "技術", "算法", "方法", "框架", "模型", "工具")
# fixed values: least scores by use
THRESHOLDS = {"route": 0.05, "similar": 0.28, "search": 0.35, "classify": 0.05, "auto": 0.30}
# fixed values: characters of a full-text query that need a backslash, and what an answer without information holds
QUERY_SPECIAL = r"""[+\-&|!(){}\[\]^"~*?:\\/]"""
NOTHING_FOUND = "找不到相關資訊"
# fixed values: patterns that read a rendered fact; its ends, and its ends with the label between them
FACT_ENDS = r"^([^(]+)\([^)]*\)\s*-\[[^\]]*\]→\s*([^(]+)\("
FACT_PARTS = r"^([^(]+)\([^)]*\)\s*-\[([^:]+):[^\]]*\]→\s*([^(]+)\([^)]*\)"
# fixed values: bounds (least, most) and defaults of request fields; texts and lists by their length
REQUESTS = {
    "search": {"text": (1, 4000, None), "top_k": (1, 50, 10), "min_score": (0.0, 1.0, 0.0)},
    "query": {"question": (1, 4000, None), "top_k": (1, 20, 5), "max_content_chars": (100, 10000, 2000)},
    "message": {"content": (0, 20000, "")},
    "chat": {"question": (1, 4000, None), "top_k": (1, 10, 5), "max_chars_per_doc": (500, 12000, 2000), "svo_hops": (1, 3, 2), "history": (0, 50, [])},
}
