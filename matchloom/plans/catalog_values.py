"""The embedding-model catalog: fixed values, in the catalog's order, as plain text."""

#: model | organization | size category | parameters | memory | dimensions | strengths | weaknesses | best use case
MODELS = """
all-MiniLM-L6-v2 | sentence-transformers | tiny | 22M | 90MB | 384 | Very fast; Lightweight; Well-tested | Lower quality than larger models | Speed-critical applications, prototyping
mixedbread-ai/mxbai-embed-large-v1 | mixedbread-ai | large | 335M | 1.3GB | 1024 | Strong performance; Good balance; Recent model | Larger than lightweight options | General purpose, production applications
dragonkue/snowflake-arctic-embed-l-v2.0-ko | dragonkue | large | 335M | 1.3GB | 1024 | Korean language optimization; Multilingual | Specialized for Korean | Korean language applications, Asian multilingual
snowflake-arctic-embed | Snowflake | large | 335M | 1.3GB | 1024 | Good balance; Production-ready; Enterprise focus | Moderate resource usage | Enterprise applications, balanced performance
nomic-ai/nomic-embed-text-v2-moe | nomic-ai | large | 137M (MoE) | 600MB | 768 | Mixture of Experts; Efficient architecture; Good quality | Complex architecture; Less tested | Research, efficient high-quality embeddings
nomic-embed-text | nomic-ai | medium | 137M | 600MB | 768 | Efficient; Good quality; Open source | Newer model family | Efficient embeddings, research applications
Linq-AI-Research/Linq-Embed-Mistral | Linq-AI-Research | large | 400M | 1.6GB | 1024 | Mistral-based; Strong performance; Recent | Moderate resource usage | High-quality general purpose embeddings
Alibaba-NLP/gte-Qwen2-7B-instruct | Alibaba-NLP | extra_large | 7B | 7GB | 3584 | Excellent quality; Instruction-tuned; SOTA performance | Very large; Slow inference; High memory | Maximum quality applications, research
qwen2 | Alibaba-NLP | extra_large | 1.5B-7B | 3-7GB | 1536-3584 | Strong performance; Multiple sizes; Instruction-tuned | Large variants require significant resources | High-quality embeddings, various resource constraints
intfloat/multilingual-e5-large-instruct | intfloat | large | 335M | 1.3GB | 1024 | Excellent multilingual; Instruction-tuned; Proven | Larger than monolingual alternatives | Multilingual applications, cross-lingual tasks
multilingual-e5-large-instruct | intfloat | large | 335M | 1.3GB | 1024 | Excellent multilingual; Instruction-tuned; Proven | Larger than monolingual alternatives | Multilingual applications, cross-lingual tasks
Salesforce/SFR-Embedding-Mistral | Salesforce | extra_large | 7B | 7GB | 4096 | Top MTEB performance; Excellent quality; Well-documented | Very large; Slow inference | Maximum quality, research, high-stakes applications
sfr-embedding-mistral | Salesforce | extra_large | 7B | 7GB | 4096 | Top MTEB performance; Excellent quality; Well-documented | Very large; Slow inference | Maximum quality, research, high-stakes applications
GritLM/GritLM-7B | GritLM | extra_large | 7B | 7GB | 4096 | Unified model; Strong performance; Novel approach | Very large; Complex architecture | Research, unified embedding and generation tasks
intfloat/e5-mistral-7b-instruct | intfloat | extra_large | 7B | 7GB | 4096 | Excellent quality; Instruction-tuned; Proven family | Very large; Slow inference | High-quality embeddings, instruction-following tasks
Alibaba-NLP/gte-Qwen2-1.5B-instruct | Alibaba-NLP | medium | 1.5B | 3GB | 1536 | Good balance; Instruction-tuned; Efficient | Moderate resource usage | Balanced quality and efficiency
Lajavaness/bilingual-embedding-large | Lajavaness | large | 335M | 1.3GB | 1024 | Bilingual optimization; Specialized | Limited to specific language pairs | Specific bilingual applications
Salesforce/SFR-Embedding-2_R | Salesforce | extra_large | 7B | 7GB | 4096 | Latest Salesforce model; Improved performance; High quality | Very large; Slow inference | Latest high-quality embeddings, research
deepseek-r1 | DeepSeek | extra_large | 7B-67B | 7-67GB | 4096 | Advanced reasoning; Latest model; Strong performance | Very large; High resource requirements | Advanced reasoning tasks, research applications
llama3.2 | Meta | extra_large | 1B-90B | 1-90GB | 2048-8192 | Strong base model; Multiple sizes; Well-supported | Large variants require significant resources | General purpose, various scales available
gemma | Google | small | 2B-7B | 2-7GB | 2048-3072 | Lightweight; Google quality; Efficient | Smaller than top performers | Lightweight applications, edge deployment
gemma2 | Google | medium | 2B-27B | 2-27GB | 2304-4608 | Improved over Gemma; Good balance; Latest Google | Moderate resource usage | Balanced performance, production applications
phi3 | Microsoft | small | 3.8B | 4GB | 3072 | Efficient; Small but capable; Microsoft quality | Limited compared to larger models | Efficient deployments, edge computing
phi4 | Microsoft | extra_large | 14B | 14GB | 5120 | Latest Phi model; Strong performance; Efficient architecture | Large size | High-quality applications, latest Microsoft tech
mistral | Mistral AI | extra_large | 7B-22B | 7-22GB | 4096-8192 | Strong performance; European model; Good quality | Large resource requirements | High-quality embeddings, European preference
"""

#: category | models | description | characteristics | recommendations
CATEGORIES = """
lightweight | all-MiniLM-L6-v2; nomic-embed-text; phi3; gemma | Fast, lightweight models for speed-critical applications | memory_usage=Low (< 200MB); inference_speed=Very Fast; quality=Good; dimensions=384; best_for=Speed over quality | when_to_use=When you need fast inference and can accept slightly lower quality; avoid_when=Maximum quality is required
fast_embedding | BAAI/bge-small-en-v1.5; sentence-transformers/all-MiniLM-L6-v2; snowflake/snowflake-arctic-embed-xs; BAAI/bge-small-zh-v1.5; jinaai/jina-embeddings-v2-small-en; snowflake/snowflake-arctic-embed-s; BAAI/bge-small-en; nomic-ai/nomic-embed-text-v1.5-Q; BAAI/bge-base-en-v1.5; sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2; Qdrant/clip-ViT-B-32-text | Ultra-fast, optimized embedding models prioritizing speed and efficiency | memory_usage=Very Low (67MB - 250MB); inference_speed=Extremely Fast; quality=Good to Very Good; dimensions=384-768; best_for=Real-time applications, high-throughput systems; special_features=ONNX optimized, quantized versions available, multilingual support | when_to_use=Real-time search, chatbots, mobile apps, high-volume processing, latency-critical applications; avoid_when=Research requiring highest possible accuracy, complex domain-specific tasks; performance_notes=Ideal for production systems where sub-second response times are critical
high_performance | Salesforce/SFR-Embedding-Mistral; sfr-embedding-mistral; Salesforce/SFR-Embedding-2_R; GritLM/GritLM-7B; intfloat/e5-mistral-7b-instruct; Alibaba-NLP/gte-Qwen2-7B-instruct; qwen2; deepseek-r1; llama3.2; mistral; phi4 | Large, high-quality models for maximum performance | memory_usage=High (3-8GB); inference_speed=Slower; quality=Excellent; dimensions=4096+; best_for=Maximum quality | when_to_use=When quality is paramount and you have sufficient compute resources; avoid_when=Speed is critical or limited resources
balanced | mixedbread-ai/mxbai-embed-large-v1; Linq-AI-Research/Linq-Embed-Mistral; Alibaba-NLP/gte-Qwen2-1.5B-instruct; snowflake-arctic-embed; gemma2 | Balanced models offering good quality with reasonable resource usage | memory_usage=Medium (1-3GB); inference_speed=Moderate; quality=Very Good; dimensions=1024-2048; best_for=General purpose use | when_to_use=Default choice for most applications; avoid_when=Extreme speed or quality requirements
specialized | nomic-ai/nomic-embed-text-v2-moe | Models with specialized architectures (MoE, novel approaches) | memory_usage=Variable; inference_speed=Variable; quality=High for specific tasks; dimensions=Variable; best_for=Specialized use cases | when_to_use=Experimental work or when architecture benefits are needed; avoid_when=Standard applications where proven models suffice
"""

#: use case | models, best first
USE_CASES = """
speed_critical | all-MiniLM-L6-v2; phi3; gemma; nomic-embed-text
general_purpose | mixedbread-ai/mxbai-embed-large-v1; Linq-AI-Research/Linq-Embed-Mistral; Alibaba-NLP/gte-Qwen2-1.5B-instruct; snowflake-arctic-embed; gemma2
maximum_quality | Salesforce/SFR-Embedding-2_R; Salesforce/SFR-Embedding-Mistral; deepseek-r1; Alibaba-NLP/gte-Qwen2-7B-instruct; qwen2; intfloat/e5-mistral-7b-instruct; phi4; mistral; llama3.2
research_experimental | nomic-ai/nomic-embed-text-v2-moe; nomic-embed-text; GritLM/GritLM-7B; deepseek-r1
production_balanced | mixedbread-ai/mxbai-embed-large-v1; Alibaba-NLP/gte-Qwen2-1.5B-instruct; Linq-AI-Research/Linq-Embed-Mistral; snowflake-arctic-embed; gemma2
memory_constrained | all-MiniLM-L6-v2; phi3; gemma; nomic-ai/nomic-embed-text-v2-moe; nomic-embed-text
instruction_following | intfloat/multilingual-e5-large-instruct; multilingual-e5-large-instruct; Alibaba-NLP/gte-Qwen2-7B-instruct; qwen2; intfloat/e5-mistral-7b-instruct; Alibaba-NLP/gte-Qwen2-1.5B-instruct; deepseek-r1
efficient_architecture | nomic-ai/nomic-embed-text-v2-moe; nomic-embed-text; phi3; phi4; gemma2
fast_embedding | BAAI/bge-small-en-v1.5; sentence-transformers/all-MiniLM-L6-v2; snowflake/snowflake-arctic-embed-xs; BAAI/bge-small-zh-v1.5; jinaai/jina-embeddings-v2-small-en; snowflake/snowflake-arctic-embed-s; BAAI/bge-small-en; nomic-ai/nomic-embed-text-v1.5-Q; BAAI/bge-base-en-v1.5; sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2; Qdrant/clip-ViT-B-32-text
"""

#: model | provider | dimensions | max tokens
API_MODELS = """
text-embedding-ada-002 | openai | 1536 | 8191
text-embedding-3-small | openai | 1536 | 8191
text-embedding-3-large | openai | 3072 | 8191
models/embedding-001 | gemini | 768 | 2048
models/text-embedding-004 | gemini | 768 | 2048
"""

#: method | description
FUZZY_METHODS = """
token_sort_ratio | Token-based similarity with sorting
token_set_ratio | Token-based similarity with set operations
ratio | Standard Levenshtein ratio
partial_ratio | Partial string matching
"""


def rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in text.strip().splitlines()]


def items(cell: str) -> list[str]:
    return [x.strip() for x in cell.split(";")]
