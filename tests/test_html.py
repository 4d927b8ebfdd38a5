"""HTML extraction edge cases: container rules, price forms, failures."""

from catalytics.sources import html as H


def cards(spark, html):
    df = spark.createDataFrame([(1, html)], "page_number int, html string")
    return [r.asDict() for r in H.extract_cards(df, base="https://b.example").orderBy("position").collect()]


CARD = ('<div class="hm_bu search-item-card-wrapper-gallery"><a class="jr_g" href="{href}"><h3 class="jr_kp"> {name} '
        '</h3></a><div class="jr_kr">{price}</div><span class="jr_j7">+ 1 000 vendus</span>'
        '<div class="jr_ae"><span class="jr_ae">B</span><span class="jr_ae">A</span></div>'
        '<div class="jr_k2"><img class="ms_mv" title=" A "></div></div>')


def test_direct_children_only_and_price_forms(spark):
    c1 = CARD.format(href="//h/p1", name="one", price="<span>MAD</span><span>143</span><span>.</span><span>97</span>")
    c2 = CARD.format(href="/p2", name="two", price="MAD 9 . 50")
    nested = '<div class="x">' + CARD.format(href="/p3", name="three", price="MAD 1") + "</div>"
    rows = cards(spark, f'<html><div id="card-list">{c1}{nested}{c2}</div></html>')
    assert [r["name"] for r in rows] == ["one", "two"]
    assert rows[0]["url"] == "https://h/p1" and rows[1]["url"] == "https://b.example/p2"
    assert rows[0]["price"] == "MAD 143.97" and rows[1]["price"] == "MAD 9.50"
    assert rows[0]["sales_info"] == "1 000 vendus"
    assert rows[0]["additional_badges"] == "A | B"
    assert rows[0]["original_price"] == "N/A" and rows[0]["image_url"] == "N/A"


def test_page_without_container_yields_nothing(spark):
    assert cards(spark, "<html><div id='other'></div></html>") == []


def test_detail_styles_and_markers(spark):
    page = ('<h1 id="pageTitle"><span class="ProductName-primary">P</span><span class="ProductName-alt"> A </span>'
            '</h1><div class="ProductDetails-form__price"><div class="ProductPrice"><span>x</span>'
            '<span class="ProductPrice-price">$5</span><span class="ProductPrice-taxLabel">VAT</span></div></div>'
            '<span class="bv-rating-label">(12 reviews)</span>')
    df = spark.createDataFrame([("u1", page), ("u2", "<p>nothing</p>")], "url string, html string")
    joined = {r.url: r for r in H.extract_details(df).collect()}
    paren = {r.url: r for r in H.extract_details(df, style="paren").collect()}
    assert joined["u1"].name == "P A" and paren["u1"].name == "P (A)"
    assert joined["u1"].price == "$5 (VAT)" and paren["u1"].price == "x (VAT)"
    assert joined["u1"].reviews_count == "12 reviews" and paren["u1"].reviews_count == "N/A"
    assert {r.name for r in H.extract_details(spark.createDataFrame([("u3", None)], "url string, html string")).collect()} == {"Error processing page"}
    assert joined["u2"].name == "N/A (pageTitle H1 not found)" and joined["u2"].price == "N/A"


def test_card_class_is_the_whole_attribute(spark):
    other = CARD.replace("hm_bu search-item-card-wrapper-gallery", "{cls}")
    fill = dict(href="/p", name="x", price="MAD 1")
    page = "".join(other.format(cls=c, **fill) for c in ("hm_bu  search-item-card-wrapper-gallery", "search-item-card-wrapper-gallery hm_bu",
                                                        "hm_bu search-item-card-wrapper-gallery more"))
    assert len(cards(spark, f"<div id='card-list'>{page}</div>")) == 1


def test_reviews_take_document_order_and_price_a_class_part(spark):
    page = ('<h1 id="pageTitle"></h1><div class="ProductDetails-header-V2-metadata"><p class="bv_numReviews_text">(7)</p></div>'
            '<button class="bv_main_container_row_flex"><div class="bv_numReviews_text">(9)</div></button>'
            '<div class="ProductDetails-form__price"><div class="ProductPrice"><span>x</span><span class="ProductPrice-price--sale">$5</span></div></div>')
    df = spark.createDataFrame([("u", page)], "url string, html string")
    (joined,), (paren,) = H.extract_details(df).collect(), H.extract_details(df, style="paren").collect()
    assert joined.reviews_count == "7" and paren.reviews_count == "9"
    assert joined.price == "$5" and paren.price == "x" and joined.name == "N/A (Name structure not found)"


def test_deep_pages_and_links(spark):
    page = "<div>" * 20000 + "<a HREF='../c?x=1&amp;y=2'>a</a><a href=/d data-href=/no>b</a><a href=\"?p=2\">c</a><a href='/d'>d</a><a>e</a>"
    df = spark.createDataFrame([(1, "https://h.example/a/b/", page), (2, None, None)], "page_id long, url string, html string")
    got = [(r["rank"], r["link"]) for r in H.page_links(df).orderBy("rank").collect()]
    assert got == [(1, "https://h.example/a/c?x=1&y=2"), (2, "https://h.example/d"), (3, "https://h.example/a/b/?p=2")]
    assert H.page_links(df, cap=2).count() == 2


def test_badge_forms_and_failed_pages(spark):
    card = ('<div class="hm_bu search-item-card-wrapper-gallery"><div class="jr_ae x"><i><span class="jr_ae">deep</span></i><span class="jr_ae"> S </span></div>'
            '<div class="jr_k2"><img class="ms_mv"><span class="ms_mu"> a<b> b </b></span></div><div class="jr_k2"><img class="ms_mv" title="S"></div>'
            '<div class="jr_k2">none</div><a class="jr_g">x</a></div>')
    df = spark.createDataFrame([(1, f"<div id=card-list>{card}</div>"), (2, None), (3, "")], "page_number int, html string")
    (row,) = H.extract_cards(df).collect()
    assert row.additional_badges == "S | ab" and row.url == "N/A" and row.name == "N/A" and row.page_number == 1


def test_nested_outer_elements_give_each_inner_once(spark):
    page = ('<ul class="row"><li class="product-container ProductCard"><ul class="row"><li class=product-container><a class=ProductCard-link href=/1>x</a></li></ul></li></ul>'
            '<ul class="ProductCardListing-grid"><li class="ProductCard"><a class=ProductCard-link href=/2>x</a></li></ul><li class=ProductCard><a class=ProductCard-link href=/3></a></li>')
    df = spark.createDataFrame([(1, "https://h.example/", page), (2, "u", ""), (3, None, None)], "page_id long, url string, html string")
    got = [(r["rank"], r["link"]) for r in H.page_links(df, cards=H.product_cards, link=("a", "ProductCard-link")).orderBy("rank").collect()]
    assert got == [(1, "https://h.example/1"), (2, "https://h.example/2")]
    assert H.page_links(df.limit(0)).count() == 0
