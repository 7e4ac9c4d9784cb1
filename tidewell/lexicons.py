"""Vocabularies and weights as data. Every operator takes them as arguments, so another domain brings its own."""

# fmt: off

#: Terms of the field itself
CORE_TERMS = {
    "artificial intelligence": 5, "machine learning": 5, "deep learning": 5, "neural network": 4, "large language model": 5, "llm": 4,
    "natural language processing": 4, "nlp": 3, "computer vision": 4, "generative ai": 5, "gen ai": 4, "genai": 4, "transformer": 3,
    "diffusion model": 4, "foundation model": 4, "multimodal": 3, "reinforcement learning": 4, "rlhf": 4, "人工智能": 5, "机器学习": 5, "深度学习": 5, "神经网络": 4,
    "大语言模型": 5, "大模型": 4, "自然语言处理": 4, "计算机视觉": 4, "生成式ai": 5, "生成式人工智能": 5, "多模态": 3,
}

#: Models and companies
PRODUCT_TERMS = {
    "gpt": 3, "gpt-4": 4, "gpt-5": 4, "chatgpt": 4, "o1": 3, "o3": 3, "claude": 4, "gemini": 4, "llama": 3, "mistral": 3, "copilot": 3, "cursor": 3,
    "sora": 4, "midjourney": 3, "stable diffusion": 3, "dall-e": 3, "whisper": 3, "openai": 4, "anthropic": 4, "deepmind": 4, "google ai": 3,
    "nvidia ai": 3, "meta ai": 3, "microsoft ai": 3, "文心一言": 4, "通义千问": 4, "豆包": 3, "kimi": 3, "智谱": 3, "chatglm": 3, "qwen": 3, "deepseek": 3, "星火": 3,
    "讯飞": 3, "百川": 3,
}

#: Terms that hint at the field
WEAK_TERMS = {
    "ai": 2, "ml": 2, "model": 1, "algorithm": 2, "neural": 2, "training": 1, "inference": 2, "fine-tune": 2, "fine tuning": 2, "embedding": 2,
    "vector": 1, "prompt": 2, "rag": 2, "agent": 2, "autonomous": 2, "intelligent": 1, "smart": 1, "bot": 1, "chatbot": 2, "assistant": 1, "智能": 1,
    "模型": 1, "算法": 2, "训练": 1, "推理": 2,
}

#: Terms of other fields
OFF_TOPIC = (
    "football", "basketball", "soccer", "nba", "nfl", "sports", "olympics", "足球", "篮球", "体育", "奥运", "celebrity", "movie star", "actor", "actress",
    "entertainment", "gossip", "明星", "娱乐", "八卦", "电影明星", "election", "vote", "president", "senator", "congress", "选举", "投票", "总统", "stock price",
    "forex", "cryptocurrency price", "bitcoin price", "股价", "外汇", "币价", "weather", "recipe", "diet", "fashion", "天气", "食谱", "减肥", "时尚",
)

#: Sources of the field
FIELD_SOURCES = (
    "arxiv", "huggingface", "openai", "anthropic", "deepmind", "github", "machine learning", "ai news", "ai blog", "机器之心", "量子位", "jiqizhixin", "qbitai",
)

#: Terms of trusted sources
TRUSTED = (
    "official", "blog", "press release", "announcement", "techcrunch", "reuters", "bloomberg", "the verge", "wired", "官方", "官网", "新闻稿", "公告",
)

#: Content type terms
RESEARCH = {
    "arxiv": 4, "paper": 4, "publication": 4, "peer-reviewed": 4, "neurips": 4, "icml": 4, "iclr": 4, "cvpr": 4, "acl": 4, "emnlp": 4, "aaai": 4,
    "sigir": 4, "kdd": 4, "naacl": 4, "coling": 4, "论文": 4, "学术": 4, "conference": 2, "journal": 2, "proceedings": 2, "academic": 2, "methodology": 2,
    "ablation": 2, "baseline": 2, "state-of-the-art": 2, "sota": 2, "期刊": 2, "会议": 2, "消融": 2, "we propose": 1, "we present": 1, "our method": 1,
    "our approach": 1, "experiments show": 1, "results demonstrate": 1, "本文提出": 1, "实验表明": 1,
}

#: Terms without which nothing is research
STRONG_RESEARCH = (
    "arxiv", "paper", "publication", "peer-reviewed", "neurips", "icml", "iclr", "cvpr", "acl", "emnlp", "aaai", "sigir", "kdd", "naacl", "coling", "论文",
    "学术",
)

#: Content type terms
DEVELOPER = {
    "github": 3, "repository": 3, "open source": 3, "commit": 3, "pull request": 3, "sdk": 3, "api documentation": 3, "开源": 3, "仓库": 3, "代码库": 3,
    "library": 2, "framework": 2, "implementation": 2, "tutorial": 2, "guide": 2, "documentation": 2, "developer": 2, "programming": 2, "开发": 2, "库": 2,
    "框架": 2, "教程": 2, "文档": 2, "指南": 2, "code": 1, "api": 1, "package": 1, "tool": 1, "代码": 1, "工具": 1,
}

#: Content type terms
PRODUCT = {
    "official release": 3, "officially launched": 3, "announces launch": 3, "unveil": 3, "debut": 3, "available now": 3, "now available": 3,
    "rolls out": 3, "ships": 3, "goes live": 3, "general availability": 3, "gpt-4o": 3, "gpt-4-turbo": 3, "o1": 3, "o1-preview": 3, "o1-mini": 3,
    "o3": 3, "claude-3": 3, "claude-3.5": 3, "claude-3-opus": 3, "claude-3-sonnet": 3, "gemini": 3, "gemini-pro": 3, "gemini-ultra": 3, "gemini 2.0": 3,
    "sora": 3, "veo": 3, "imagen 3": 3, "firefly": 3, "llama-3": 3, "llama-3.1": 3, "llama-3.2": 3, "copilot": 3, "github copilot": 3, "cursor": 3,
    "正式发布": 3, "正式推出": 3, "正式上线": 3, "官方发布": 3, "全面开放": 3, "豆包": 3, "doubao": 3, "kimi": 3, "通义千问": 3, "qwen": 3, "文心一言": 3, "ernie": 3, "星火": 3,
    "spark": 3, "release": 2, "launch": 2, "announce": 2, "introduce": 2, "version": 2, "update": 2, "available": 2, "upgrade": 2, "new feature": 2,
    "new model": 2, "latest version": 2, "发布": 2, "推出": 2, "宣布": 2, "上线": 2, "版本": 2, "升级": 2, "更新": 2, "official": 1, "commercial": 1, "enterprise": 1,
    "product": 1, "platform": 1, "service": 1, "solution": 1, "beta": 1, "preview": 1, "pro": 1, "plus": 1, "premium": 1, "subscription": 1, "model": 1,
    "api": 1, "app": 1, "tool": 1, "assistant": 1, "官方": 1, "商业": 1, "企业": 1, "产品": 1, "平台": 1, "服务": 1, "公测": 1, "订阅": 1, "模型": 1, "助手": 1, "工具": 1,
    "应用": 1,
}

#: Content type terms
MARKET = {
    "funding round": 3, "investment": 3, "acquisition": 3, "ipo": 3, "valuation": 3, "revenue": 3, "raises": 3, "secures funding": 3, "series a": 3,
    "series b": 3, "series c": 3, "series d": 3, "unicorn": 3, "billion": 3, "million": 3, "融资": 3, "投资": 3, "收购": 3, "上市": 3, "估值": 3, "轮融资": 3,
    "独角兽": 3, "亿美元": 3, "亿元": 3, "market": 2, "business": 2, "startup": 2, "company": 2, "policy": 2, "regulation": 2, "industry": 2, "layoff": 2,
    "layoffs": 2, "antitrust": 2, "lawsuit": 2, "copyright": 2, "license": 2, "ai act": 2, "executive order": 2, "ban": 2, "restrict": 2, "市场": 2,
    "企业": 2, "公司": 2, "政策": 2, "监管": 2, "行业": 2, "裁员": 2, "反垄断": 2, "版权": 2, "合规": 2, "法案": 2, "funding": 1, "partnership": 1, "collaboration": 1,
    "deal": 1, "contract": 1, "profit": 1, "loss": 1, "growth": 1, "strategy": 1, "compete": 1, "competition": 1, "rival": 1, "ceo": 1, "executive": 1,
    "hire": 1, "hiring": 1, "合作": 1, "伙伴": 1, "交易": 1, "合同": 1, "营收": 1, "增长": 1, "战略": 1, "竞争": 1, "对手": 1, "招聘": 1,
}

#: Content type terms
LEADER = {
    "interview": 3, "speech": 3, "keynote": 3, "statement": 3, "exclusive interview": 3, "in an interview": 3, "采访": 3, "演讲": 3, "主题演讲": 3, "声明": 3,
    "said": 2, "stated": 2, "believes": 2, "warns": 2, "predicts": 2, "says": 2, "told": 2, "claims": 2, "according to": 2, "opinion": 2, "commented": 2,
    "表示": 2, "认为": 2, "警告": 2, "预测": 2, "评论": 2, "观点": 2, "称": 2, "指出": 2, "透露": 2, "tweeted": 1, "posted": 1, "quote": 1, "说": 1, "发文": 1,
}

#: Technical fields
TECH = {
    "NLP": [
        "nlp", "natural language", "text mining", "embedding", "bert", "transformer", "sentiment analysis", "translation", "linguistics", "tokenization",
        "自然语言", "文本挖掘", "语义", "翻译", "词向量",
    ],
    "Computer Vision": [
        "vision", "image", "video", "detection", "recognition", "segmentation", "ocr", "yolo", "resnet", "vit", "视觉", "图像", "视频", "识别", "检测",
    ],
    "Reinforcement Learning": [
        "reinforcement", "rl", "agent", "policy", "reward", "q-learning", "ppo", "强化学习", "智能体", "奖励",
    ],
    "Generative AI": [
        "generative", "generation", "aigc", "llm", "large language model", "foundation model", "gpt", "chatgpt", "claude", "llama", "mistral", "gemini",
        "copilot", "grok", "sora", "midjourney", "dalle", "stable diffusion", "runway", "pika", "flux", "text-to-image", "text-to-video", "生成式", "大模型",
        "语言模型", "文生图", "文生视频",
    ],
    "MLOps": [
        "mlops", "deployment", "production", "monitoring", "pipeline", "部署", "运维",
    ],
    "AI Ethics": [
        "ethics", "bias", "fairness", "privacy", "safety", "alignment", "伦理", "偏见", "隐私", "安全", "对齐",
    ],
}

#: Regions, in the order in which ties are settled
REGIONS = {
    "China": [
        "china", "chinese", "beijing", "shanghai", "baidu", "alibaba", "tencent", "中国", "百度", "阿里", "腾讯",
    ],
    "USA": [
        "usa", "us", "silicon valley", "openai", "google", "microsoft", "meta", "美国",
    ],
    "Europe": [
        "europe", "eu", "european", "mistral", "deepmind", "欧洲",
    ],
    "Global": [
        "global", "international", "worldwide", "全球", "国际",
    ],
}

#: Phrase patterns of the content types
PHRASES = {
    "product": [
        "officially\\s+(launched|released|announced)", "now\\s+available\\s+(for|to|in)", "rolling\\s+out\\s+to", "is\\s+now\\s+(live|available|open)",
        "has\\s+(launched|released|unveiled)", "introduces?\\s+new", "正式(发布|上线|推出|开放)", "全面(开放|上线|推出)", "(开始|开启)(内测|公测|商用)",
    ],
    "research": [
        "we\\s+propose", "we\\s+present", "we\\s+introduce\\s+a\\s+(new|novel)", "our\\s+(method|approach|model)\\s+(achieves?|outperforms?)",
        "state-of-the-art\\s+(results?|performance)", "benchmark\\s+results?", "experiments?\\s+(show|demonstrate)", "(本文|我们)(提出|介绍|研究)",
        "(实验|结果)(表明|显示|证明)",
    ],
    "market": [
        "raises?\\s+\\$?\\d+\\s*(m|million|b|billion)", "valued\\s+at\\s+\\$", "acquisition\\s+of", "acquires?\\s+", "ipo\\s+(filing|plans?)",
        "layoffs?\\s+at", "(获得|完成).{0,10}(融资|投资)", "估值.{0,5}(亿|万)", "(收购|并购)", "团队.{0,10}(扩张|扩大|增加|招聘|裁员)", "(扩张|扩招|裁员).{0,5}(至|到)?\\s*\\d+\\s*人",
        "(公司|企业|集团).{0,10}(裁员|招聘|扩招)",
    ],
    "leader": [
        "(ceo|cto|founder|chief).{0,20}(said|says|stated|believes|warns|predicts|told|claims)", "in\\s+(an\\s+)?interview",
        "(sam altman|elon musk|jensen huang|sundar pichai|mark zuckerberg|satya nadella).{0,30}(said|says|warns|predicts|believes|told)",
        ".{0,10}(表示|称|认为|指出|警告|预测|透露)", "(马斯克|黄仁勋|奥特曼|扎克伯格|李彦宏|马化腾|雷军).{0,10}(表示|称|认为|说)", "^.{2,10}[：:].{5,}$",
    ],
}

#: Content type priors of sources; the first contained name counts
PRIORS = {
    "arxiv": {"research": 0.95, "developer": 0.02, "product": 0.01, "market": 0.01, "leader": 0.01},
    "arxiv.org": {"research": 0.95, "developer": 0.02, "product": 0.01, "market": 0.01, "leader": 0.01},
    "github": {"developer": 0.9, "research": 0.05, "product": 0.03, "market": 0.01, "leader": 0.01},
    "github.com": {"developer": 0.9, "research": 0.05, "product": 0.03, "market": 0.01, "leader": 0.01},
    "huggingface": {"developer": 0.7, "research": 0.2, "product": 0.05, "market": 0.03, "leader": 0.02},
    "hugging face": {"developer": 0.7, "research": 0.2, "product": 0.05, "market": 0.03, "leader": 0.02},
    "techcrunch": {"product": 0.4, "market": 0.35, "developer": 0.1, "research": 0.05, "leader": 0.1},
    "the verge": {"product": 0.45, "market": 0.25, "developer": 0.1, "research": 0.05, "leader": 0.15},
    "wired": {"product": 0.35, "market": 0.25, "research": 0.15, "developer": 0.1, "leader": 0.15},
    "mit technology review": {"research": 0.4, "product": 0.25, "market": 0.15, "developer": 0.1, "leader": 0.1},
    "product hunt": {"product": 0.7, "developer": 0.2, "market": 0.05, "research": 0.03, "leader": 0.02},
    "hacker news": {"developer": 0.4, "product": 0.25, "research": 0.15, "market": 0.1, "leader": 0.1},
    "openai": {"product": 0.5, "research": 0.3, "developer": 0.1, "leader": 0.08, "market": 0.02},
    "google ai": {"product": 0.45, "research": 0.35, "developer": 0.1, "leader": 0.05, "market": 0.05},
    "microsoft": {"product": 0.5, "developer": 0.25, "market": 0.15, "research": 0.05, "leader": 0.05},
    "anthropic": {"product": 0.45, "research": 0.35, "developer": 0.1, "leader": 0.05, "market": 0.05},
    "36氪": {"market": 0.5, "product": 0.35, "leader": 0.08, "developer": 0.05, "research": 0.02},
    "36kr": {"market": 0.5, "product": 0.35, "leader": 0.08, "developer": 0.05, "research": 0.02},
    "机器之心": {"research": 0.35, "product": 0.3, "developer": 0.15, "market": 0.1, "leader": 0.1},
    "量子位": {"product": 0.35, "research": 0.3, "market": 0.15, "developer": 0.1, "leader": 0.1},
    "it之家": {"product": 0.5, "market": 0.25, "developer": 0.1, "research": 0.05, "leader": 0.1},
    "rss": {"product": 0.35, "market": 0.3, "developer": 0.15, "research": 0.1, "leader": 0.1},
    "feed": {"product": 0.35, "market": 0.3, "developer": 0.15, "research": 0.1, "leader": 0.1},
    "news": {"product": 0.3, "market": 0.35, "leader": 0.15, "developer": 0.1, "research": 0.1},
    "_default": {"product": 0.3, "market": 0.25, "developer": 0.2, "research": 0.15, "leader": 0.1},
}

#: Company names
COMPANIES = (
    "google", "microsoft", "openai", "anthropic", "meta", "apple", "amazon", "baidu", "alibaba", "tencent", "bytedance", "huawei", "xiaomi", "nvidia",
    "xai", "x.ai", "elon musk", "sam altman", "sundar pichai", "百度", "阿里", "腾讯", "字节", "华为", "小米", "英伟达", "deepseek", "mistral", "cohere", "stability",
    "midjourney", "runway", "智谱", "月之暗面", "零一万物", "百川", "科大讯飞",
)

#: Product names
PRODUCTS = (
    "chatgpt", "gpt-4", "gpt-5", "gpt4", "gpt5", "o1", "o3", "claude", "gemini", "copilot", "cursor", "sora", "midjourney", "llama", "mistral", "qwen",
    "deepseek", "kimi", "doubao", "grok", "perplexity", "poe", "character.ai", "pi", "文心", "通义", "豆包", "星火", "spark",
)

#: Verbs of statements
LEADER_VERBS = (
    "said", "says", "stated", "believes", "warns", "predicts", "tweeted", "posted", "commented", "argues", "thinks", "expects", "suggests", "claims",
    "reveals", "discusses", "explains", "tells", "told", "表示", "认为", "称", "警告", "预测", "发文", "透露", "指出", "强调",
)

#: Signs of an interview
STRONG_STATEMENT = (
    "interview", "exclusive", "in conversation", "spoke about", "专访", "对话", "接受采访", "表态", "回应", "谈到",
)

#: Event terms
EVENTS = (
    "conference", "summit", "forum", "event", "ceremony", "大会", "峰会", "论坛", "盛典", "活动", "会议", "发布会", "年会", "年终", "开幕", "闭幕", "颁奖", "典礼",
)

#: Roles and known persons
ROLES = (
    "ceo", "cto", "coo", "cfo", "founder", "co-founder", "cofounder", "chief", "president", "director", "vp", "vice president", "head of", "executive",
    "chairman", "chairwoman", "sam altman", "elon musk", "jensen huang", "sundar pichai", "satya nadella", "mark zuckerberg", "demis hassabis",
    "dario amodei", "ilya sutskever", "andrej karpathy", "yann lecun", "geoffrey hinton", "fei-fei li", "mustafa suleyman", "eric schmidt", "黄仁勋", "马斯克",
    "扎克伯格", "奥特曼", "纳德拉", "李飞飞", "吴恩达", "李开复", "周鸿祎", "雷军", "李彦宏", "马化腾", "张一鸣", "任正非", "王兴",
)

#: Titles that need a strong sign
GENERIC_TITLES = (
    "创始人", "首席", "总裁", "董事长", "董事", "总经理",
)

#: Negations and hedges
NEGATIONS = {
    "fake": 3, "false": 3, "denied": 3, "debunk": 2.5, "not": 2, "虚假": 3, "否认": 3, "辟谣": 2.5, "不是": 2, "rumor": 2, "speculation": 2, "unconfirmed": 2,
    "allegedly": 1.5, "传闻": 2, "谣言": 2, "未经证实": 2, "据称": 1.5, "delayed": 1.5, "cancelled": 2, "suspended": 1.5, "延期": 1.5, "取消": 2, "暂停": 1.5,
    "might": 1, "could": 1, "possibly": 1, "可能": 1, "或许": 1,
}

#: Acts that a negation may be about
ACTIONS = (
    "release", "launch", "announce", "unveil", "publish", "发布", "推出", "宣布", "公布", "上线",
)

#: Authority of sources
AUTHORITY = {
    "openai.com": 1.0, "openai": 1.0, "blog.google": 1.0, "google ai": 0.95, "ai.meta.com": 1.0, "meta ai": 0.95, "anthropic.com": 1.0,
    "anthropic": 0.95, "microsoft.com": 0.95, "blogs.microsoft": 0.95, "nvidia": 0.9, "arxiv.org": 0.95, "arxiv": 0.95, "github.com": 0.9, "github": 0.9,
    "huggingface.co": 0.9, "hugging face": 0.9, "baidu": 0.9, "百度": 0.9, "alibaba": 0.9, "阿里": 0.9, "tencent": 0.9, "腾讯": 0.9, "deepseek": 0.9,
    "智谱": 0.85, "月之暗面": 0.85, "kimi": 0.85, "techcrunch": 0.85, "theverge": 0.8, "the verge": 0.8, "wired": 0.8, "technologyreview": 0.85,
    "mit technology review": 0.85, "ieee spectrum": 0.85, "artificialintelligence-news": 0.8, "syncedreview": 0.8, "机器之心": 0.85, "jiqizhixin": 0.85,
    "量子位": 0.8, "qbitai": 0.8, "infoq": 0.75, "36kr": 0.7, "36氪": 0.7, "ithome": 0.7, "it之家": 0.7, "reddit": 0.65, "producthunt": 0.7,
    "product hunt": 0.7, "hacker news": 0.7, "hnrss": 0.7, "news.google": 0.5, "bing.com/news": 0.5, "reuters": 0.75, "bloomberg": 0.75,
    "sam altman": 0.9, "karpathy": 0.9, "andrej karpathy": 0.9, "lex fridman": 0.8,
}

#: Relevance, first layer
BREAKTHROUGH = {
    "breakthrough": 0.18, "sota": 0.15, "state-of-the-art": 0.15, "world record": 0.15, "revolutionary": 0.14, "game-changer": 0.14, "milestone": 0.12,
    "paradigm shift": 0.15, "first-ever": 0.14, "突破": 0.18, "里程碑": 0.14, "革命性": 0.14, "颠覆": 0.12, "史上首次": 0.15, "重大突破": 0.16,
}

#: Relevance, second layer
RELEASE = {
    "release": 0.1, "launch": 0.1, "announce": 0.1, "unveil": 0.12, "introduce": 0.08, "available": 0.08, "official": 0.1, "beta": 0.06, "preview": 0.06,
    "alpha": 0.05, "general availability": 0.1, "ga": 0.08, "v1.0": 0.08, "发布": 0.1, "推出": 0.1, "上线": 0.1, "正式版": 0.1, "官宣": 0.1, "官方": 0.08, "公测": 0.06,
    "内测": 0.05,
}

#: Relevance, third layer
TECHNIQUE = {
    "open source": 0.1, "open-source": 0.1, "opensource": 0.1, "benchmark": 0.08, "evaluation": 0.06, "paper": 0.06, "gpt": 0.06, "llm": 0.06,
    "transformer": 0.05, "diffusion": 0.06, "multimodal": 0.08, "reasoning": 0.08, "chain-of-thought": 0.08, "agent": 0.08, "agi": 0.1, "agentic": 0.08,
    "fine-tune": 0.06, "finetune": 0.06, "rlhf": 0.07, "inference": 0.05, "training": 0.05, "dataset": 0.06, "开源": 0.1, "模型": 0.05, "大模型": 0.07,
    "多模态": 0.08, "推理": 0.06, "训练": 0.05, "微调": 0.06, "数据集": 0.06,
}

#: Relevance, fourth layer
GENERAL = {
    "new": 0.03, "update": 0.04, "improve": 0.04, "enhance": 0.04, "feature": 0.03, "support": 0.03, "capability": 0.04, "performance": 0.05,
    "faster": 0.04, "better": 0.03, "最新": 0.04, "更新": 0.04, "升级": 0.05, "优化": 0.04, "新增": 0.04, "支持": 0.03, "功能": 0.03,
}

#: Relevance that is taken off
DOUBT = {
    "rumor": -0.08, "speculation": -0.06, "might": -0.03, "may": -0.02, "could": -0.02, "possibly": -0.04, "unconfirmed": -0.08, "alleged": -0.06,
    "reportedly": -0.04, "传闻": -0.08, "据悉": -0.04, "或将": -0.04, "可能": -0.03, "疑似": -0.06, "未经证实": -0.08,
}

#: Relevance factor of a content type
TYPE_FACTORS = {
    "research": 1.15, "product": 1.12, "leader": 1.08, "developer": 1.05, "tutorial": 1.0, "news": 0.95, "market": 0.88, "community": 0.85,
    "opinion": 0.8, "other": 0.75,
}

#: Decay per day of a content type
DECAY = {
    "product": 0.15, "news": 0.14, "market": 0.1, "research": 0.08, "tutorial": 0.06, "leader": 0.1,
}

#: Words that are no keywords
STOPWORDS = (
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "that", "this", "these", "those", "with", "from", "by", "as", "into",
    "through", "during", "before", "after", "above", "below", "between", "says", "said", "predicts", "predicted", "tells", "told", "according", "thanks",
    "about", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "each", "every", "both", "few",
    "more", "most", "other", "some", "such", "no", "not", "only", "own", "same", "so", "than", "too", "very", "just", "also", "now", "new", "first",
    "last", "long", "great", "little", "make", "can", "like", "back", "even", "well", "way", "our", "out", "its", "it", "up", "go", "going", "get",
    "getting", "come", "coming", "become", "becoming",
)

#: Terms of product news
LAUNCH_TERMS = (
    "launch", "release", "announce", "unveil", "introduce", "debut", "new product", "new version", "update", "upgrade", "available", "official", "beta",
    "preview", "api", "service", "platform", "发布", "推出", "上线", "正式", "新版本", "新功能", "产品", "服务", "平台", "公测", "内测",
)

#: Company of a feed; the first contained domain counts
COMPANY_DOMAINS = {
    "openai.com": "OpenAI", "blog.google": "Google", "blogs.microsoft.com": "Microsoft", "ai.meta.com": "Meta", "anthropic.com": "Anthropic",
    "jiqizhixin.com": "China_Tech", "qbitai.com": "China_Tech",
}

#: Addresses that change between runs
UNSTABLE_URLS = (
    "news.google.com/rss/articles/", "feedburner.com", "/redirect/",
)

#: Feeds by group
FEEDS = {
    "research": [
        "http://export.arxiv.org/rss/cs.AI", "http://export.arxiv.org/rss/cs.CL", "http://export.arxiv.org/rss/cs.CV", "http://export.arxiv.org/rss/cs.LG",
    ],
    "news": [
        "https://www.theverge.com/rss/ai-artificial-intelligence/index.xml", "https://techcrunch.com/category/artificial-intelligence/feed/",
        "https://www.wired.com/feed/tag/ai/latest/rss", "https://spectrum.ieee.org/rss/topic/artificial-intelligence",
        "https://www.technologyreview.com/feed/", "https://artificialintelligence-news.com/feed/", "https://syncedreview.com/feed/",
        "https://www.36kr.com/feed", "https://www.ithome.com/rss/", "https://www.jiqizhixin.com/rss", "https://www.qbitai.com/feed",
        "https://www.infoq.cn/feed/topic/18",
    ],
    "developer": [
        "https://github.blog/feed/", "https://huggingface.co/blog/feed.xml", "https://openai.com/blog/rss.xml", "https://blog.google/technology/ai/rss/",
    ],
    "product_news": [
        "https://openai.com/blog/rss.xml", "https://blog.google/technology/ai/rss/", "https://blogs.microsoft.com/ai/feed/", "https://ai.meta.com/blog/rss/",
        "https://www.anthropic.com/news/rss", "https://www.jiqizhixin.com/rss", "https://www.qbitai.com/feed",
    ],
    "community": [
        "https://www.producthunt.com/feed?category=artificial-intelligence",
    ],
    "leader_blogs": [
        {"url": "http://blog.samaltman.com/posts.atom", "author": "Sam Altman", "title": "OpenAI CEO"},
        {"url": "https://karpathy.github.io/feed.xml", "author": "Andrej Karpathy", "title": "AI Researcher"},
        {"url": "https://lexfridman.com/feed/podcast/", "author": "Lex Fridman", "title": "Podcast Host", "type": "podcast"},
    ],
}

#: Terms by which a free reply is read
REPLY_TERMS = {
    "llm": [
        "llm", "large language model", "language model", "gpt", "chatgpt", "claude", "gemini",
    ],
    "product": [
        "product", "launch", "release", "announce", "new feature",
    ],
    "research": [
        "research", "paper", "study", "academic", "arxiv", "conference",
    ],
    "industry": [
        "industry", "business", "company", "enterprise", "market",
    ],
    "tools": [
        "tool", "framework", "library", "sdk", "api",
    ],
    "ethics": [
        "ethics", "safety", "regulation", "policy", "bias", "fairness",
    ],
    "vision": [
        "vision", "image", "video", "computer vision", "visual",
    ],
    "robotics": [
        "robot", "robotics", "autonomous", "embodied",
    ],
}

#: Other names of content types
REPLY_ALIASES = {
    "paper": "research", "academic": "research", "study": "research", "release": "product", "launch": "product", "tool": "developer", "news": "market",
    "funding": "market", "opinion": "leader", "discussion": "community", "trend": "community",
}

#: Names shown as authors
PERSONS = (
    "Jensen Huang", "Sam Altman", "Elon Musk", "Sundar Pichai", "Satya Nadella", "Mark Zuckerberg", "Demis Hassabis", "Dario Amodei", "Yann LeCun",
    "Andrew Ng", "Fei-Fei Li", "Geoffrey Hinton", "Ilya Sutskever", "Andrej Karpathy", "Greg Brockman", "Mira Murati", "Jeff Bezos", "Tim Cook",
    "Bill Gates", "Guido van Rossum", "Robin Li", "Jack Ma", "Pony Ma", "Lei Jun", "Zhang Yiming",
)

#: Terms of the field in collected titles and summaries, and in discussion titles.
TOPIC_TERMS = (
    "ai", "artificial intelligence", "machine learning", "deep learning", "neural network", "llm", "gpt", "transformer", "chatgpt",
    "人工智能", "机器学习", "深度学习", "神经网络",
)
DISCUSSION_TERMS = ("ai", "llm", "gpt", "machine learning", "deep learning", "neural", "openai", "anthropic", "chatgpt")

#: Query keys that only track visitors.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "source", "fbclid", "gclid", "ocid")

#: Further names of content types in replies to batches.
BATCH_ALIASES = REPLY_ALIASES | {
    "papers": "research", "releases": "product", "tools": "developer", "models": "developer", "tools/models": "developer",
    "investment": "market", "funding/news": "market", "quote": "leader", "insight": "leader", "opinions": "leader", "trends": "community",
}

#: Fixed values: (low threshold, high threshold, weight) of engagement signals.
ENGAGEMENT = {
    "stars": (100, 50000, 1.0), "downloads": (1000, 1000000, 0.9), "reddit": (50, 5000, 0.85),
    "points": (30, 1000, 0.85), "likes": (100, 10000, 0.7), "comments": (20, 500, 0.6),
}

#: Words too common to describe a content type.
COMMON_WORDS = ("the", "and", "for", "with", "from", "that", "this")

CONTENT_TYPES = ("research", "developer", "product", "market", "leader")

#: The technical fields that reviewers choose from by number.
REVIEW_TECH = ("NLP", "Computer Vision", "Reinforcement Learning", "Generative AI", "MLOps", "AI Ethics", "General AI")

#: Leaders whose statements are searched for, and their titles.
LEADERS = {
    "Sam Altman": "OpenAI CEO",
    "Elon Musk": "xAI Founder",
    "Jensen Huang": "NVIDIA CEO",
    "Demis Hassabis": "Google DeepMind CEO",
    "Yann LeCun": "Meta Chief AI Scientist",
    "Geoffrey Hinton": "AI Pioneer",
    "Andrew Ng": "AI Fund Managing General Partner",
    "Kai-Fu Lee": "01.AI CEO",
    "Robin Li": "Baidu CEO",
}

#: Rows that stand in for sources that give too little. Their date is the run's.
BACKUP = {
    "leader": (
        {"title": "Sam Altman: AI发展的速度将超出所有人的预期", "summary": "OpenAI CEO Sam Altman在最近的采访中表示，AGI的到来可能比预期的要快，社会需要为此做好准备。", "url": "https://openai.com/blog", "source": "Interview", "author": "Sam Altman", "author_title": "OpenAI CEO"},
        {"title": "Elon Musk: AI安全是未来的首要任务", "summary": "Elon Musk再次强调AI安全的重要性，并表示xAI的目标是理解宇宙的本质，构建最大限度追求真理的AI。", "url": "https://x.ai", "source": "X (Twitter)", "author": "Elon Musk", "author_title": "xAI Founder"},
        {"title": "Jensen Huang: 生成式AI是计算领域的转折点", "summary": "NVIDIA CEO黄仁勋表示，生成式AI正在重塑每一个行业，计算方式正在发生根本性的转变。", "url": "https://nvidianews.nvidia.com/", "source": "Keynote", "author": "Jensen Huang", "author_title": "NVIDIA CEO"},
        {"title": "Yann LeCun: 现在的LLM还不是真正的智能", "summary": "Meta首席AI科学家Yann LeCun认为，目前的大语言模型缺乏对物理世界的理解，距离真正的通用人工智能还有很长的路要走。", "url": "https://ai.meta.com/blog/", "source": "Interview", "author": "Yann LeCun", "author_title": "Meta Chief AI Scientist"},
        {"title": "李开复: AI 2.0时代已经到来", "summary": "零一万物CEO李开复表示，AI 2.0时代将带来比移动互联网大十倍的机会，中国在应用层有巨大优势。", "url": "https://www.01.ai/", "source": "Speech", "author": "Kai-Fu Lee", "author_title": "01.AI CEO"},
    ),
    "research": (
        {"title": "Attention Is All You Need: Transformer架构深度分析", "summary": "深入分析Transformer架构在自然语言处理中的革命性作用，探讨注意力机制的原理和应用。", "url": "https://arxiv.org/abs/1706.03762", "source": "arXiv", "authors": ["AI Research Team"], "categories": ["cs.CL", "cs.AI"]},
    ),
    "repositories": (
        {"title": "transformers", "summary": "🤗 Transformers: State-of-the-art Machine Learning for PyTorch, TensorFlow, and JAX.", "url": "https://github.com/huggingface/transformers", "source": "GitHub", "stars": 132000, "language": "Python"},
    ),
    "models": (
        {"title": "HF Model: microsoft/DialoGPT-medium", "summary": "最新AI模型发布: microsoft/DialoGPT-medium，下载量: 1500000", "url": "https://huggingface.co/microsoft/DialoGPT-medium", "source": "Hugging Face", "downloads": 1500000},
    ),
    "blog": (
        {"title": "GitHub Copilot最新功能更新", "summary": "GitHub Copilot推出新功能，支持更多编程语言和更智能的代码建议，提升开发效率。", "url": "https://github.blog", "source": "GitHub Blog"},
    ),
}

#: The source suffix of a title, as written and in lower case.
TITLE_SUFFIX, LOWER_TITLE_SUFFIX = r"\s*[-|—]\s*[A-Z][a-zA-Z\s&.']+$", r"\s*[-|—]\s*[a-z][a-z\s&.']+$"

#: Where a text names whose statement it is.
NAME_PLACES = (
    r"^([A-Z][a-z]+ [A-Z][a-z]+)(?:\s*:|\s+says|\s+said)",
    r"(?:CEO|Chief|President|Founder)\s+([A-Z][a-z]+ [A-Z][a-z]+)",
    r"([A-Z][a-z]+ [A-Z][a-z]+)\s+(?:CEO|Chief|President|Founder)",
)
