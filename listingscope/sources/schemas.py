"""Shapes of the raw files. Field names are fixed by the files themselves."""

REVIEW = """review_number int, rating int, date string, text string, likes int, images array<string>,
    image_count int, has_images boolean, produto_id string, produto_titulo string, produto_url string"""
PAYLOAD = """catalog_product_id string, official_store_id string, seller_id bigint, logistic_type string,
    reviews struct<rate: double, count: int>,
    alternative_buying_options array<struct<seller_id: string>>,
    shipping_promise struct<address_options: array<struct<origins: array<struct<value: string>>>>>"""


def _as_struct(fields: str) -> str:
    """"a int, b struct<x: int>" as the inside of struct<…>."""
    out, depth = [], 0
    part = ""
    for ch in " ".join(fields.split()):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    out.append(part.strip())
    return "struct<" + ", ".join(p.replace(" ", ": ", 1) for p in out) + ">"


LISTING = f"""id string, product_id string, catalog_product_id string, product_code string,
    titulo string, link string, preco string, preco_original string, desconto string,
    vendedor string, vendedor_nome string, seller_id string, reputation_level string, power_seller_status string,
    vendedor_total_transacoes bigint, rating_medio double, total_reviews int,
    rating_5_estrelas int, rating_4_estrelas int, rating_3_estrelas int, rating_2_estrelas int, rating_1_estrela int,
    reviews_com_texto int, reviews_com_imagens int, imagem_url string, frete_gratis boolean,
    categoria string, marca string, modelo string, condicao string, disponibilidade string,
    quantidade_vendida string, descricao string, rating_estrelas double,
    distribuicao_estrelas map<string, int>, caracteristicas map<string, string>,
    todos_reviews array<{_as_struct(REVIEW)}>,
    dados_brutos struct<melidata: {_as_struct(PAYLOAD)}>"""
LISTING_FILE = f"{LISTING}, produtos array<{_as_struct(LISTING)}>, produto {_as_struct(LISTING)}"
REVIEW_BUNDLE = f"""product_id string, general_data struct<average_rating: double, total_reviews: int>,
    ai_summary struct<summary: string, likes: int, available: boolean>,
    characteristics_ratings map<string, double>, reviews array<{_as_struct(REVIEW)}>"""
SELLER = """id bigint, nickname string, address struct<state: string, city: string>, user_type string,
    seller_reputation struct<level_id: string, power_seller_status: string, transactions: struct<total: bigint>>,
    status struct<site_status: string>"""
SELLER_FILE = f"dados_vendedores array<{_as_struct(SELLER)}>"
PRICE_FILE = "product string, family string, price_text string"

# Column names of the original tables and their names here.
RENAME = {
    "id_anuncio": "listing_id", "catalog_product_id": "catalog_id", "titulo": "title", "link_anuncio": "link",
    "imagem_url_principal": "image_url", "descricao": "description", "tipo_cartucho": "cartridge_type",
    "quantidade_por_anuncio": "quantity", "cores_detalhadas": "colours", "usado_seminovo": "used",
    "vendedor_nome": "seller_name", "vendedor_total_transacoes": "transactions", "power_seller_status": "power_status",
    "vendedor_reputacao_num": "reputation", "vendedor_lider": "leader", "e_loja_oficial": "official",
    "preco_atual": "price", "preco_sugerido_hp": "suggested_price", "diferenca_preco_perc": "price_gap",
    "rating_medio_produto": "rating", "total_reviews_produto": "n_reviews", "distribuicao_estrelas": "star_counts",
    "perc_reviews_negativas": "negative_share", "rating_ponderado": "weighted_rating",
    "flag_inconsistencia_xl": "xl_mismatch", "condicao": "condition", "origem_envio": "ship_origin",
    "conexoes_vendedores_alt": "alt_sellers", "marca": "brand", "modelo": "model",
    "possui_reviews_texto": "has_review_text", "num_reviews_analisadas": "n_texts",
    "sentimento_medio_reviews": "sentiment", "contagem_alegacao_fraude": "fraud_hits",
    "contagem_performance_negativa": "performance_hits", "nome_arquivo": "file_name", "phash": "image_hash",
    "contagem_reuso_imagem": "image_reuse", "num_imagens_produto": "n_images",
    "score_de_suspeita": "score", "is_fraud_suspect_v2": "suspect", "ml_score": "model_score", "score_hibrido": "hybrid",
    "grafo_num_conexoes": "degree", "grafo_comunidade_id": "community", "grafo_num_vizinhos": "neighbours",
    "grafo_vizinhos_suspeitos": "neighbour_suspects", "grafo_taxa_suspeita_vizinhos": "neighbour_rate",
    "grafo_peso_total_conexoes": "total_weight", "grafo_peso_medio_conexoes": "mean_weight",
    "grafo_tamanho_comunidade": "community_size", "grafo_total_suspeitos_comunidade": "community_suspects",
    "grafo_total_produtos_comunidade": "community_listings", "grafo_taxa_suspeita_comunidade": "community_rate",
    "grafo_betweenness": "betweenness", "grafo_closeness": "closeness", "grafo_pagerank": "pagerank",
}


def original_names(df):
    """The table with the column names its first users know."""
    back = {ours: theirs for theirs, ours in RENAME.items()}
    return df.withColumnsRenamed({c: back[c] for c in df.columns if c in back})
