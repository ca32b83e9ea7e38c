"""Review rules for Portuguese text, as a table; the order is the priority.

# Patterns and corrections must equal what users get today.
Each rule: category, severity, pattern between word boundaries, correction. In corrections \\1 is the group's text,
\\l1 the group in lower case; "=" at the start keeps the correction's own case instead of the match's.
"""

from __future__ import annotations

LETTERS = r"[^\W\d_]"

SPELLING = [
    (r"fas(er|endo|e|emos|em|ia|iam|erem)", r"faz\l1"),
    (r"fasso", "faço"),
    (r"fis", "fiz"),
    (r"trabah(o|os|a|am|ar|ando|ou|ará|arão)", r"trabalh\l1"),
    (r"esempl(o|os|ar|ares)", r"exempl\l1"),
    (r"caz(a|as)", r"cas\l1"),
    (r"geit(o|os|oso|osa|inho)", r"jeit\l1"),
    (r"menas", "menos"),
    (r"seje(m)?", r"seja\l1"),
    (r"esteje(m)?", r"esteja\l1"),
    (r"previlégi(o|os)", r"privilégi\l1"),
    (r"beneficient(e|es)", r"beneficent\l1"),
    (r"sombrancelh(a|as)", r"sobrancelh\l1"),
    (r"estrup(o|os|ar|ou)", r"estupr\l1"),
    (r"mending(o|os)", r"mendig\l1"),
    (r"reinvindic(ar|ação|ações|a|am|ou)", r"reivindic\l1"),
    (r"pararel(o|os|a|as)", r"paralel\l1"),
    (r"poblem(a|as)", r"problem\l1"),
    (r"mortandel(a|as)", r"mortadel\l1"),
    (r"iorgut(e|es)", r"iogurt\l1"),
    (r"pesquiz(a|as|ar|ou|am)", r"pesquis\l1"),
    (r"analiz(ar|ação|ou|am)", r"analis\l1"),
    (r"paraliz(ar|ação|ações|ou)", r"paralis\l1"),
    (r"obcess(ão|ões|ado|ada)", r"obsess\l1"),
    (r"excess(ão|ões)", r"exceç\l1"),
    (r"estens(ão|ões)", r"extens\l1"),
    (r"ascenç(ão|ões)", r"ascens\l1"),
    (r"concerteza", "com certeza"),
    (r"derrepente", "de repente"),
    (r"porisso", "por isso"),
    (r"apartir\s+de", "a partir de"),
    (r"con", "com"),
    (rf"an([pb]{LETTERS}+)", r"am\1"),
    (rf"in([pb]{LETTERS}+)", r"im\1"),
    (rf"en([pb]{LETTERS}+)", r"em\1"),
    (rf"len([pb]{LETTERS}+)", r"lem\1"),
]

ACCENTS = [
    (r"ortografic(o|os|a|as)", r"ortográfic\l1"),
    (r"voce(s)?", r"você\l1"),
    (r"nao", "não"),
    (r"tambem", "também"),
    (r"ate", "até"),
    (r"ja", "já"),
    (r"tres", "três"),
    (r"mes", "mês"),
    (r"saude", "saúde"),
    (r"histori(a|as)", r"históri\l1"),
    (r"relatori(o|os)", r"relatóri\l1"),
    (r"negoci(o|os)", r"negóci\l1"),
    (r"juridic(o|os|a|as)", r"jurídic\l1"),
    (r"public(o|os|a|as)", r"públic\l1"),
    (r"logic(o|os|a|as)", r"lógic\l1"),
    (r"duvid(a|as)", r"dúvid\l1"),
    (r"otim(o|os|a|as)", r"ótim\l1"),
    (r"facil", "fácil"),
    (r"dificil", "difícil"),
    (r"rapid(o|os|a|as)", r"rápid\l1"),
    (r"epoc(a|as)", r"époc\l1"),
    (r"unic(o|os|a|as)", r"únic\l1"),
    (r"numer(o|os)", r"númer\l1"),
    (r"codig(o|os)", r"códig\l1"),
    (r"modul(o|os)", r"módul\l1"),
    (r"lingu(a|as)", r"língu\l1"),
    (r"pagin(a|as)", r"págin\l1"),
    (r"clausul(a|as)", r"cláusul\l1"),
    (r"prejuiz(o|os)", r"prejuíz\l1"),
    (r"veicul(o|os)", r"veícul\l1"),
    (r"possivel", "possível"),
    (r"possiveis", "possíveis"),
    (r"incrivel", "incrível"),
    (r"sustentavel", "sustentável"),
    (r"responsavel", "responsável"),
    (r"responsaveis", "responsáveis"),
    (r"util", "útil"),
    (r"inutil", "inútil"),
]

WE = {"vai": "vamos", "foi": "fomos", "faz": "fazemos", "fez": "fizemos", "faria": "faríamos", "iria": "iríamos", "era": "éramos", "é": "somos", "tem": "temos", "tinha": "tínhamos", "está": "estamos", "tá": "estamos", "estava": "estávamos", "tava": "estávamos", "sabe": "sabemos", "soube": "soubemos", "quer": "queremos", "quis": "quisemos", "pode": "podemos", "pôde": "pudemos", "viu": "vimos", "falou": "falamos", "disse": "dissemos", "chegou": "chegamos", "saiu": "saímos"}
THEY = {"vai": "vão", "foi": "foram", "faz": "fazem", "fez": "fizeram", "era": "eram", "é": "são", "está": "estão", "tá": "estão", "estava": "estavam", "tava": "estavam", "sabe": "sabem", "soube": "souberam", "quer": "querem", "quis": "quiseram", "pode": "podem", "pôde": "puderam", "viu": "viram", "falou": "falaram", "disse": "disseram", "chegou": "chegaram", "saiu": "saíram"}
PEOPLE = {"fomos": "foi", "vamos": "vai", "faremos": "fará", "iremos": "irá", "fizeram": "fez", "fizemos": "fez", "éramos": "era", "estamos": "está", "estivemos": "esteve", "tínhamos": "tinha", "sabemos": "sabe", "queremos": "quer", "podemos": "pode", "dissemos": "disse", "vimos": "viu", "chegamos": "chegou"}
PLURALS = {"homem": "homens", "mulher": "mulheres", "mês": "meses", "item": "itens"}
NOUNS = "cara|pessoa|homem|mulher|menino|menina|garoto|garota|criança|amigo|amiga|documento|arquivo|foto|imagem|dia|mês|ano|problema|caso|fato|ponto|livro|carro|coisa|casa|conta|texto|item|produto"
SAID = {"disse": "disseram", "fez": "fizeram", "falou": "falaram", "afirmou": "afirmaram", "pensou": "pensaram"}
GERUNDS = {"fazendo": "fazer", "enviando": "enviar", "analisando": "analisar", "verificando": "verificar", "entrando": "entrar", "conferindo": "conferir", "revisando": "revisar"}

#: A correction may be a pair (text, table): \\t2 is then the table's entry for group 2 in lower case.
AGREEMENT = [
    (rf"houveram\s+({LETTERS}+)", r"=houve \1"),
    (r"fazem\s+(\d+|dois|três|quatro|cinco|muitos|vários)\s+(anos?|meses?|dias?|semanas?)", r"=faz \1 \2"),
    (r"para\s+mim\s+(fazer|comprar|dizer|ver|ir|trazer|ler|pagar|escrever|analisar|estudar)", r"=para eu \1"),
    (rf"(nós|nos)\s+({'|'.join(WE)})", (r"nós \t2", WE)),
    (rf"(a\s+gente|agente)\s+({'|'.join(PEOPLE)})", (r"a gente \t2", PEOPLE)),
]
AGENT = [
    (r"agente\s+(foi|vai|faz|fez|disse|diz|falou|fala|quer|quis|pode|pôde|tem|tinha|está|estava|tá|tava|sabe|soube|saiu|sai|chegou|chega|viu|vê|pensou|pensa|achou|acha|gostou|gosta|ficou|fica|precisa|precisou|consegue|conseguiu|entende|entendeu)", r"a gente \1"),
]
MORE_AGREEMENT = [
    (rf"(eles|elas)\s+({'|'.join(THEY)})", (r"\l1 \t2", THEY)),
    (rf"(os|as|esses|essas|estes|estas|aqueles|aquelas|meus|minhas|seus|suas|nossos|nossas)\s+({NOUNS})", (r"\1 \t2", {n: PLURALS.get(n, n + "s") for n in NOUNS.split("|")})),
    (r"as\s+(pessoas)\s+(disse|falou|afirmou|pensou|fez)", (r"as pessoas \t2", SAID)),
    (r"os\s+documentos\s+(comprova|mostra|indica|apresenta)", r"os documentos \l1m"),
    (r"meio-dia\s+e\s+meio", "meio-dia e meia"),
    (r"meia\s+(cansada|nervosa|preocupada|atenta|chateada)", r"=meio \1"),
    (r"assistir\s+o\s+(filme|jogo|vídeo|documento|espetáculo)", r"=assistir ao \1"),
    (rf"obedecer\s+o\s+({LETTERS}+)", r"=obedecer ao \1"),
    (rf"desobedecer\s+o\s+({LETTERS}+)", r"=desobedecer ao \1"),
    (rf"prefer(ir|o|e|em|imos)\s+({LETTERS}+)\s+do\s+que", r"=prefer\1 \2 a"),
    (r"namorar\s+com", "namorar"),
]

GRAVE = [
    (r"à\s+(partir|fazer|comparecer|discutir|ver|pagar|escrever|solicitar|requerer|ajuizar|cumprir)", r"=a \1"),
    (r"à\s+(pé|prazo|cavalo|bordo|tempo|esmo|favor|respeito|critério|juízo|título|nível)", r"=a \1"),
    (r"(dia|frente|passo|face|lado|ponto)\s+à\s+\1", r"=\1 a \1"),
    (r"as\s+(vezes|noites|tardes|pressas|claras|escondidas|avessas)", r"=às \1"),
    (r"a\s+(medida\s+que|proporção\s+que|noite|tarde|vista|toa|risca|revelia|vontade|espera\s+de)", r"=à \1"),
    (r"as\s+(\d{1,2})h", r"=às \1h"),
    (r"as\s+(\d{1,2})\s+horas", r"=às \1 horas"),
]

CONFUSED = [
    (r"vultuos(os?|as?)", r"vultos\l1"),
    (r"(mandato)(\s+de\s+(?:prisão|busca|apreensão|soltura|condução|penhora))", r"@mandado\2"),
    (r"(mandado)(\s+(?:eletivo|presidencial|parlamentar|tampão))", r"@mandato\2"),
    (r"intervido", "intervindo"),
    (r"haja\s+vistos?", "haja vista"),
    (r"ao\s+ponto\s+de", "a ponto de"),
    (r"sob\s+judice", "sub judice"),
    (r"por\s+que(?=\s*[?!.])", "por quê"),
    (r"(o|um|este|esse)\s+por\s+que", r"=\1 porquê"),
    (r"mal\s+(humor|humorado|exemplo|caráter|pressentimento)", r"=mau \1"),
    (r"mau\s+(educado|feito|intencionado|acabado|sucedido)", r"=mal \1"),
    (r"a\s+(\d+|dois|três|quatro|cinco)\s+anos\s+atrás", r"=há \1 anos"),
]

REDUNDANT = [
    (r"subir\s+para\s+cima", "subir"),
    (r"descer\s+para\s+baixo", "descer"),
    (r"entrar\s+para\s+dentro", "entrar"),
    (r"sair\s+para\s+fora", "sair"),
    (r"elo\s+de\s+ligação", "elo"),
    (r"fato\s+real", "fato"),
    (r"certeza\s+absoluta", "certeza"),
    (r"monopólio\s+exclusivo", "monopólio"),
    (r"acabamento\s+final", "acabamento"),
    (r"pequenos\s+detalhes", "detalhes"),
    (r"panorama\s+geral", "panorama"),
    (r"protagonista\s+principal", "protagonista"),
    (r"conclusão\s+final", "conclusão"),
]

STYLE = [
    (r"a\s+n[ií]vel\s+de", "em termos de"),
    (r"vir\s+a\s+ser", "ser"),
    (rf"vamos\s+(estar)\s+({'|'.join(GERUNDS)})", (r"vamos \t2", GERUNDS)),
    (rf"vou\s+(estar)\s+({'|'.join(GERUNDS)})", (r"vou \t2", GERUNDS)),
    (r"ao\s+meu\s+ver", "a meu ver"),
    (r"sob\s+a\s+ótica", "sob a perspectiva"),
    (r"(situação|situações|cenário|cenários|caso|casos|hipótese|hipóteses|momento|momentos|contexto|contextos|fase|fases)\s+onde", r"=\1 em que"),
    (r"(cuj(?:o|a|os|as))\s+(?:o|a|os|as)", r"=\1"),
]

#: Corrections offered beside the first, by pattern.
ALTERNATIVES = {
    r"elo\s+de\s+ligação": ("ligação",),
    r"a\s+(\d+|dois|três|quatro|cinco)\s+anos\s+atrás": (r"=\1 anos atrás",),
    r"a\s+n[ií]vel\s+de": ("=no âmbito de", "=em termos de", "=quanto a"),
    r"sob\s+a\s+ótica": ("=sob a perspectiva", "=sob o ponto de vista"),
    r"(situação|situações|cenário|cenários|caso|casos|hipótese|hipóteses|momento|momentos|contexto|contextos|fase|fases)\s+onde": (r"=\1 na qual",),
}
SUGGESTED = {r"ao\s+ponto\s+de"}
WARNED = {r"(cuj(?:o|a|os|as))\s+(?:o|a|os|as)"}

#: Category, default severity, rules.
GROUPS = [
    ("SPELLING", "warning", SPELLING),
    ("ACCENTUATION", "warning", ACCENTS),
    ("GRAMMAR_AGREEMENT", "warning", AGREEMENT),
    ("PARONYM_CONTEXT", "warning", AGENT),
    ("GRAMMAR_AGREEMENT", "warning", MORE_AGREEMENT),
    ("CRASE_USAGE", "warning", GRAVE),
    ("PARONYM_CONTEXT", "warning", CONFUSED),
    ("PLEONASM_REDUNDANCY", "suggestion", REDUNDANT),
    ("STYLE_SUGGESTION", "suggestion", STYLE),
]

MESSAGES = {
    "DUPLICATE_WORD": "The same word stands twice in a row.",
    "SPELLING": "Frequent misspelling.",
    "ACCENTUATION": "An accent is missing.",
    "GRAMMAR_AGREEMENT": "Agreement or government of a verb or noun.",
    "PARONYM_CONTEXT": "A similar word is meant here.",
    "CRASE_USAGE": "Use of the grave accent.",
    "PLEONASM_REDUNDANCY": "The expression repeats itself.",
    "STYLE_SUGGESTION": "A plainer wording is preferred.",
    "SPACE_BEFORE_PUNCTUATION": "Blank before punctuation.",
    "TRAILING_WHITESPACE": "Blank at the end of the line.",
    "REPEATED_WHITESPACE": "More than one blank.",
}
