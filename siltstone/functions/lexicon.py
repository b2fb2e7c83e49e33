"""Word lists and tables that results depend on. Fixed values, as plain text; pass others to any function that takes them."""

from __future__ import annotations

#: Characters that normalization replaces one for one (Arabic forms, Arabic digits, zero-width non-joiner).
CHARACTERS = {
    "ك": "ک", "ي": "ی", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9", "٠": "0",
    "ة": "ه", "ئ": "ی", "إ": "ا", "أ": "ا", "آ": "ا", "ؤ": "و", "‌": " ",
}

#: Stop words.
STOP_WORDS = (
    "از به با در بر را که این آن و یا اما ولی برای تا هر چه چرا اگر مگر پس نیز حتی همه هیچ "
    "خود باید شاید چون زیرا بنابراین سپس گرچه درباره بدون توسط علاوه بین همچنین بسیار برخی می های ها ی است "
    "نیست بود شد شود کرد کند شده می‌شود می‌کند دارد ندارد"
).split(" ")

#: Punctuation that tokenization deletes besides ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~،؛؟«»"

#: Legal domains and their keywords.
DOMAINS = {
    "criminal": "جرم، مجازات، زندان، حبس، قصاص، دیه، تعزیر، قانون مجازات، جزا، بزهکار، متهم، مجرم، شاکی، بزه، جنایت، سرقت، قتل، جرح، ضرب، حدود، کلاهبرداری، اختلاس، ارتشا، قاچاق",
    "civil": "قرارداد، عقد، معامله، ارث، وصیت، قانون مدنی، مالکیت، بیع، اجاره، وقف، نکاح، طلاق، مهریه، حضانت، عقود، تعهد، تملیک، تملک، خسارت، مسئولیت مدنی، ضمان، رهن، اسناد، شرط، الزام",
    "commercial": "تجارت، شرکت، سهام، تاجر، قانون تجارت، ورشکستگی، چک، سفته، برات، اوراق بهادار، بورس، قرارداد تجاری، حق العمل کاری، ضمانت نامه، حمل و نقل، بیمه، داوری تجاری، مالیات، مناقصه، مزایده",
    "administrative": "استخدام، کارگر، کارفرما، حقوق کار، قانون کار، تأمین اجتماعی، بیمه، مالیات، تخلفات اداری، دیوان عدالت اداری، قانون شهرداری، امور اداری، استخدام دولتی، ترفیع، انفصال، کارمند، خدمات کشوری",
    "constitutional": "قانون اساسی، حقوق اساسی، دولت، مجلس، قوه قضاییه، قوه مجریه، قوه مقننه، انتخابات، نظام، حکومت، جمهوری، رهبر، ریاست جمهوری، وزیر، وزارت، نمایندگان، شورای نگهبان",
}
DOMAINS = {k: v.split("، ") for k, v in DOMAINS.items()}

#: Content types and their keywords.
CONTENT_TYPES = {
    "question": "سوال، پرسش، سؤال، چرا، چگونه، آیا، چطور، چیست، کیست، کجاست، کدام، ؟، لطفا پاسخ دهید، لطفا راهنمایی کنید",
    "answer": "پاسخ، جواب، در پاسخ به، طبق قانون، بر اساس قانون، با استناد به، با توجه به قانون، به موجب ماده، طبق ماده، با احترام، باید گفت، باید عرض کنم",
    "article": "مقاله، مقدمه، چکیده، نتیجه‌گیری، بررسی، تحلیل، پژوهش، مطالعه، یافته‌ها، منابع، مآخذ، نتایج، ادبیات تحقیق، روش‌شناسی، روش تحقیق",
    "profile": "سوابق، تحصیلات، تخصص، وکیل، مشاور حقوقی، قاضی، حقوقدان، دانشگاه، مدرک، دکتری، کارشناسی، سابقه فعالیت، زمینه فعالیت، حوزه تخصصی",
}
CONTENT_TYPES = {k: v.split("، ") for k, v in CONTENT_TYPES.items()}

#: Words that make a first sentence a question, and words that cite the law.
QUESTION_WORDS = "آیا چرا چگونه چطور چیست کیست کجاست".split()
LAW_WORDS = "ماده قانون آیین‌نامه بخشنامه دستورالعمل".split(" ")

#: Marks counted by the punctuation ratio.
COUNTED_MARKS = ".,;:؛،?!؟-()[]{}«»"

#: URL parts that mark list pages, and those (as patterns) that mark detail pages.
LIST_PARTS = ["/category/", "/tag/", "/archive/", "/blog/", "/articles/", "/questions/", "/list/", "/search/", "/page/", "\\?page=", "archive", "category", "tag", "blog", "articles"]
DETAIL_PARTS = ["/post/", "/article/", "/question/", "/view/", "/show/", "/single/", r"/\d+/", r"/[^/]+/"]
#: URL patterns by which a fetched page counts as a list.
LIST_PAGE_PARTS = ["/category/", "/tag/", "/archive/", "/blog/", "/articles/", "/questions/", "/list/", "/search/", r"/page/\d+", r"/\?page=\d+"]
#: URL parts that raise a job's priority.
IMPORTANT_PARTS = ["/legal/", "/law/", "/cases/", "/judgments/", "/attorneys/", "/حقوقی/", "/قانون/", "/قوانین/", "/پرونده/", "/دادگاه/", "/وکلا/"]
#: Path parts that are no sections of a site.
ASSET_PARTS = ["wp-content", "wp-includes", "js", "css", "img", "images"]
