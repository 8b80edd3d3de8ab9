"""The technologies, site builders and third parties that are known by name.

Plain rows in the order in which they are tried; ``operators.tech`` reads them. Other sets are given as tables.
"""

from __future__ import annotations

from typing import NamedTuple


class Technology(NamedTuple):
    """``patterns``: texts in lower-case pages, any of which shows it; all of them with ``require_all``; within tags only with ``tag_only``. ``confidence``: the most that they can show."""

    name: str
    category: str
    confidence: str
    patterns: tuple[str, ...]
    require_all: bool = False
    tag_only: bool = False


# fmt: off
TECHNOLOGIES = (
    Technology("WordPress", "cms", "high", ('generator" content="wordpress', "/wp-content/", "/wp-includes/", "wp-json/wp/"), tag_only=True),
    Technology("Drupal", "cms", "high", ("drupal.js", "/sites/default/files/", "Drupal.settings"), tag_only=True),
    Technology("Joomla", "cms", "high", ("/media/jui/", "joomla!", "/components/com_"), tag_only=True),
    Technology("Wix", "builder", "high", ("static.parastorage.com", "wixstatic.com")),
    Technology("Webflow", "builder", "high", ("data-wf-page", "webflow.js", "assets.website-files.com")),
    Technology("Squarespace", "builder", "high", ("static.squarespace.com", "squarespace-cdn.com")),
    Technology("Shopify", "ecommerce", "high", ("shopify-section", "window.shopify", "shopify.shop", "cdn.shopify.com/s/files/", "shopify_analytics.js", "myshopify.com/cart")),
    Technology("WooCommerce", "ecommerce", "high", ("/wc-api/", "wc_add_to_cart", "wc-block", "woocommerce-js")),
    Technology("BigCommerce", "ecommerce", "high", ("bigcommercecdn.com", "cdn11.bigcommerce.com")),
    Technology("Magento", "ecommerce", "high", ("x-magento-init", "mage/bootstrap", "mage.cookies", "mage-init")),
    Technology("Next.js", "framework", "high", ("_next/static", "__NEXT_DATA__", "/_next/")),
    Technology("Nuxt.js", "framework", "high", ("__nuxt", "/_nuxt/", "nuxt.js")),
    Technology("React", "framework", "high", ("react.production.min.js", "react.development.js", "unpkg.com/react", "cdn.jsdelivr.net/npm/react", "/react@", "/static/js/main.", "/static/js/bundle.", "/static/js/vendors~"), tag_only=True),
    Technology("React", "framework", "high", ("data-reactroot", "data-reactid", "data-react-helmet", "/@react-refresh", "__reactFiber", "react-dom")),
    Technology("Vite", "framework", "high", ("/@vite/client", "vite/modulepreload-polyfill")),
    Technology("Vite", "framework", "medium", ("__vite__mapdeps", "vite:preloaderror", "/node_modules/.vite/")),
    Technology("Vue", "framework", "high", ("vue.min.js", "vue@"), tag_only=True),
    Technology("Vue", "framework", "high", ("vue.runtime", "__vue__")),
    Technology("Angular", "framework", "high", ("angular.min.js",), tag_only=True),
    Technology("Angular", "framework", "high", ("ng-version", "angular/core")),
    Technology("Svelte", "framework", "high", ("__svelte", "svelte/")),
    Technology("Gatsby", "framework", "high", ("___gatsby", "gatsby-chunk")),
    Technology("Remix", "framework", "high", ("__remixContext", "remix-run")),
    Technology("Astro", "framework", "high", ("astro-island", "astro-slot")),
    Technology("Google Analytics 4", "analytics", "high", ("gtag/js?id=G-", "gtag('config', 'G-", 'gtag("config", "G-')),
    Technology("Google Analytics (UA)", "analytics", "high", ("google-analytics.com/analytics.js", "gtag('config', 'UA-", 'gtag("config", "UA-')),
    Technology("Google Tag Manager", "analytics", "high", ("googletagmanager.com/gtm.js", "googletagmanager.com/ns.html")),
    Technology("Meta Pixel", "analytics", "high", ("connect.facebook.net/en_US/fbevents.js", "fbq('init'", 'fbq("init"')),
    Technology("HubSpot", "analytics", "high", ("js.hs-scripts.com", "js.hsforms.net", "js.hscta.net")),
    Technology("Hotjar", "analytics", "high", ("static.hotjar.com", "script.hotjar.com")),
    Technology("Intercom", "analytics", "high", ("widget.intercom.io", "intercomSettings")),
    Technology("Segment", "analytics", "high", ("cdn.segment.com", "segment.io/analytics")),
    Technology("Mixpanel", "analytics", "high", ("cdn.mxpnl.com", "mixpanel.com/libs", "mixpanel.init")),
    Technology("Klaviyo", "analytics", "high", ("static.klaviyo.com", "klaviyo.com/media")),
    Technology("Salesforce", "analytics", "high", ("pardot.com", "sfdcstatic.com", "force.com/resource")),
    Technology("Zendesk", "analytics", "high", ("zdassets.com", "zendeskcdn.com", "static.zdassets.com")),
    Technology("Stripe", "ecommerce", "high", ("js.stripe.com", "stripe-js")),
    Technology("Crisp Chat", "analytics", "high", ("client.crisp.chat", "crisp.chat/js")),
    Technology("Tawk.to", "analytics", "high", ("embed.tawk.to", "tawk_api")),
    Technology("Cloudflare", "cdn", "medium", ("__cf_bm", "cloudflare.com/cdn-cgi", "cloudflareinsights.com")),
    Technology("Amazon CloudFront", "cdn", "high", ("cloudfront.net",)),
    Technology("Akamai", "cdn", "high", ("akamaihd.net", "akamaized.net", "edgesuite.net")),
    Technology("Fastly", "cdn", "high", ("fastly.net", "fastlylb.net")),
    Technology("Vercel", "cdn", "high", ("vercel.app", "_vercel")),
    Technology("Netlify", "cdn", "high", ("netlify.app", "netlify.com/js")),
    Technology("jsDelivr", "cdn", "medium", ("cdn.jsdelivr.net",)),
    Technology("Bootstrap", "framework", "high", ("bootstrap.min.css", "bootstrap.min.js", "bootstrap@"), tag_only=True),
    Technology("jQuery", "framework", "high", ("jquery.min.js", "jquery-", "/jquery/"), tag_only=True),
    Technology("Tailwind CSS", "framework", "medium", ("tailwindcss", "cdn.tailwindcss.com")),
    Technology("Alpine.js", "framework", "high", ("alpinejs", "cdn.jsdelivr.net/npm/alpinejs", "x-cloak")),
    Technology("HTMX", "framework", "high", ("htmx.org", "unpkg.com/htmx")),
    Technology("YouTube Embed", "media", "high", ("youtube.com/embed", "youtube-nocookie.com/embed")),
    Technology("Vimeo Embed", "media", "high", ("player.vimeo.com/video", "vimeo.com/video")),
    Technology("Ghost", "cms", "high", ("ghost.io/", "ghost/core", "ghost-sdk")),
    Technology("HubSpot CMS", "cms", "high", ("hubspot-web-interactives", "hs-sites.com", "hubspotusercontent.com")),
    Technology("Contentful", "cms", "high", ("contentful.com/", "cdn.contentful.com")),
    Technology("Sanity", "cms", "high", ("sanity.io/", "cdn.sanity.io")),
    Technology("Strapi", "cms", "high", ("strapi.io", "/strapi/")),
    Technology("Prismic", "cms", "high", ("prismic.io", "cdn.prismic.io")),
    Technology("Storyblok", "cms", "high", ("storyblok.com", "a.storyblok.com")),
    Technology("Typo3", "cms", "high", ("typo3", "typo3conf/", "t3lib/")),
    Technology("Craft CMS", "cms", "high", ("craft-cms", "craftcms.com", "cpresources/")),
    Technology("Umbraco", "cms", "high", ("umbraco/", "umbracoapi")),
    Technology("Framer", "builder", "high", ("framerusercontent.com", "framer.com/m/", "framer.website")),
    Technology("Elementor", "builder", "high", ("elementor/assets", "elementor-widget", "elementor-section")),
    Technology("Divi", "builder", "high", ("et-pb-section", "et_pb_", "divi/js/")),
    Technology("Beaver Builder", "builder", "high", ("fl-builder", "fl-module", "bb-plugin/")),
    Technology("Bricks Builder", "builder", "high", ("bricks-data-", "bricksbuilder.io")),
    Technology("Carrd", "builder", "high", ("carrd.co", 'generator" content="carrd')),
    Technology("Jimdo", "builder", "high", ("jimdo.com/", "jimdosite.com", "jimdofree.com")),
    Technology("Strikingly", "builder", "high", ("strikingly.com", "s.strikingly.com")),
    Technology("PrestaShop", "ecommerce", "high", ("prestashop", "/modules/ps_", "presta-")),
    Technology("OpenCart", "ecommerce", "high", ("catalog/view/theme", "opencart.com", "route=common/home")),
    Technology("Ecwid", "ecommerce", "high", ("app.ecwid.com", "ecwid_script", "ecwid.com/script.js")),
    Technology("Gumroad", "ecommerce", "high", ("gumroad.com/js/", "assets.gumroad.com")),
    Technology("Snipcart", "ecommerce", "high", ("snipcart.nuxtjs.org", "cdn.snipcart.com")),
    Technology("Paddle", "ecommerce", "high", ("paddle.com/js/", "paddle.js", "Paddle.Setup")),
    Technology("SvelteKit", "framework", "high", ("sveltekit", "_app/immutable/", "@sveltejs/kit")),
    Technology("SolidJS", "framework", "high", ("solid-js", "solid.js", "_solid")),
    Technology("Qwik", "framework", "high", ("qwik.js", "qwikloader", "@builder.io/qwik")),
    Technology("Ember.js", "framework", "high", ("ember.js", "ember-source", "ember-cli")),
    Technology("Preact", "framework", "medium", ("preact.min.js", "preact/src", "preact@")),
    Technology("Lit", "framework", "high", ("lit-element", "lit-html", "@lit/reactive")),
    Technology("LinkedIn Insight Tag", "analytics", "high", ("snap.licdn.com/li.lms-analytics", "linkedin.com/px", "linkedin insight")),
    Technology("TikTok Pixel", "analytics", "high", ("analytics.tiktok.com", "tiktok pixel", "ttq.load(")),
    Technology("Pinterest Tag", "analytics", "high", ("pintrk(", "ct.pinterest.com", "s.pinimg.com/ct/core.js")),
    Technology("Twitter / X Pixel", "analytics", "high", ("static.ads-twitter.com", "twq('init'", 'twq("init"')),
    Technology("Amplitude", "analytics", "high", ("cdn.amplitude.com", "amplitude.getInstance", "amplitude.init")),
    Technology("PostHog", "analytics", "high", ("posthog.com/static", "posthog.init(", "app.posthog.com")),
    Technology("Plausible", "analytics", "high", ("plausible.io/js/", "data-domain"), require_all=True),
    Technology("Matomo", "analytics", "high", ("matomo.js", "piwik.js", "_paq.push")),
    Technology("Microsoft Clarity", "analytics", "high", ("clarity.ms/tag", "microsoft clarity")),
    Technology("FullStory", "analytics", "high", ("fullstory.com/s/fs.js", "FS.identify", "fullstory.com")),
    Technology("Heap", "analytics", "high", ("heapanalytics.com", "cdn.heapanalytics.com", "heap.load")),
    Technology("Lucky Orange", "analytics", "high", ("luckyorange.com/v7/lt.js", "luckyorange.net")),
    Technology("Tidio", "analytics", "high", ("code.tidio.co", "tidio.co/track")),
    Technology("Drift", "analytics", "high", ("js.driftt.com", "drift.load(", "api.drift.com")),
    Technology("LiveChat", "analytics", "high", ("livechatinc.com", "cdn.livechatinc.com")),
    Technology("Freshchat", "analytics", "high", ("wchat.freshchat.com", "freshchat.com/js")),
    Technology("Smartsupp", "analytics", "high", ("smartsupp.com/loader.js", "smartsupp.com")),
    Technology("Olark", "analytics", "high", ("static.olark.com", "olark.identify")),
    Technology("PayPal", "ecommerce", "high", ("paypal.com/sdk/js", "paypalobjects.com", "paypal.Buttons")),
    Technology("Square", "ecommerce", "high", ("squareup.com/js/", "square.js", "payments.squareup.com")),
    Technology("Razorpay", "ecommerce", "high", ("checkout.razorpay.com", "razorpay.open()")),
    Technology("OneTrust", "analytics", "high", ("cdn.cookielaw.org", "onetrust", "optanon")),
    Technology("Cookiebot", "analytics", "high", ("consent.cookiebot.com", "cookiebot.com/")),
    Technology("CookieYes", "analytics", "high", ("cdn-cookieyes.com", "cookieyes.com")),
    Technology("Typeform", "analytics", "high", ("typeform.com/to/", "embed.typeform.com")),
    Technology("JotForm", "analytics", "high", ("jotform.com/s/", "jotformpro.com")),
    Technology("Gravity Forms", "analytics", "high", ("gravityforms", "gform_wrapper")),
    Technology("Sentry", "analytics", "high", ("browser.sentry-cdn.com", "sentry.io/api/", "Sentry.init")),
    Technology("LogRocket", "analytics", "high", ("cdn.logrocket.io", "logrocket.init(")),
    Technology("Auth0", "framework", "high", ("auth0.com/js/", "auth0-js", "cdn.auth0.com")),
    Technology("Clerk", "framework", "high", ("clerk.browser.js", "clerk.dev/npm/@clerk", "accounts.dev")),
    Technology("Supabase", "framework", "high", ("supabase.co/auth", "supabase.js", "@supabase/supabase-js")),
    Technology("Firebase", "framework", "high", ("firebase.googleapis.com", "firebaseapp.com", "__firebase_")),
    Technology("Google Maps", "media", "high", ("maps.googleapis.com", "maps.google.com/maps", "google.com/maps/embed")),
    Technology("Mapbox", "media", "high", ("api.mapbox.com", "mapbox-gl.js")),
    Technology("Spotify Embed", "media", "high", ("open.spotify.com/embed", "spotify.com/embed")),
    Technology("SoundCloud Embed", "media", "high", ("w.soundcloud.com/player", "soundcloud.com/player")),
    Technology("Lottie", "media", "high", ("lottiefiles.com", "lottie-player", "lottie.js", "bodymovin.js")),
    Technology("Twitch Embed", "media", "high", ("player.twitch.tv", "embed.twitch.tv")),
    Technology("Replit", "cdn", "high", (".replit.app", ".repl.co")),
    Technology("GitHub Pages", "cdn", "medium", (".github.io/",)),
    Technology("Render", "cdn", "medium", (".onrender.com",)),
    Technology("Cloudflare Pages", "cdn", "high", ("pages.cloudflare.com", "pages.dev")),
    Technology("Supabase Storage", "cdn", "high", ("supabase.co/storage/",)),
    Technology("AWS S3", "cdn", "medium", ("s3.amazonaws.com", "s3-website")),
    Technology("Mailchimp", "analytics", "high", ("chimpstatic.com", "mailchimp.com/", "list-manage.com")),
    Technology("ConvertKit", "analytics", "high", ("convertkit.com/", "convertkit-form")),
    Technology("ActiveCampaign", "analytics", "high", ("activehosted.com", "activecampaign.com/acton")),
    Technology("Brevo", "analytics", "high", ("sibautomation.com", "sendinblue.com", "brevo.com")),
    Technology("Mailerlite", "analytics", "high", ("assets.mailerlite.com", "mailerlite.com/js")),
)

#: Site builders with AI and what shows them: the first that a page has counts.
AI_BUILDERS = (
    ("Framer", ("framerusercontent.com", "framer.com/m/", "framer.website", '"generator" content="framer')),
    ("Replit", (".replit.app", ".repl.co", "replit.com/@", 'generator" content="replit')),
    ("Durable", ("durable.co", "durable.site", 'generator" content="durable')),
    ("10Web", ("10web.io", 'generator" content="10web')),
    ("Hostinger Website Builder", ("hostingersite.com", "zyrosite.com", 'generator" content="zyro')),
    ("Jimdo", ("jimdo.com/", "jimdosite.com", "jimdofree.com")),
    ("B12", ("b12.io", "b12sites.com")),
    ("Dorik", ("dorik.com", "dorik.io")),
    ("Typedream", ("typedream.app", "typedream.com/fonts")),
    ("GoDaddy Website Builder", ("godaddysites.com",)),
    ("Unbounce", ("unbouncepages.com", "unbounce.com/js/")),
    ("Leadpages", ("leadpages.co", "leadpages.net/")),
    ("Carrd", ("carrd.co", 'generator" content="carrd')),
    ("Strikingly", ("strikingly.com", "s.strikingly.com")),
    ("Ucraft", ("ucraft.com", "ucraft.net")),
    ("Hocoos", ("hocoos.com",)),
    ("Bolt (StackBlitz)", ("bolt.new", "stackblitz.io", "webcontainer.io")),
    ("v0 (Vercel)", ("v0.dev/chat", 'generator" content="v0')),
    ("Lovable", ("lovable.app", "lovable.dev", 'generator" content="lovable')),
    ("Cursor", ('generator" content="cursor',)),
    ("Windsurf", ('generator" content="windsurf',)),
)

#: Third parties as they are reported, the names that they have here, and categories.
ENTITIES = (
    ("Google Analytics", "Google Analytics", "analytics"),
    ("Google/Doubleclick Ads", "Google Ads", "analytics"),
    ("Google Tag Manager", "Google Tag Manager", "analytics"),
    ("Hotjar", "Hotjar", "analytics"),
    ("Mixpanel", "Mixpanel", "analytics"),
    ("Segment", "Segment", "analytics"),
    ("Amplitude", "Amplitude", "analytics"),
    ("Heap", "Heap Analytics", "analytics"),
    ("FullStory", "FullStory", "analytics"),
    ("Chartbeat", "Chartbeat", "analytics"),
    ("Cxense", "Cxense", "analytics"),
    ("Scorecard Research", "Scorecard Research", "analytics"),
    ("New Relic", "New Relic", "analytics"),
    ("Datadog", "Datadog RUM", "analytics"),
    ("Sentry", "Sentry", "analytics"),
    ("LogRocket", "LogRocket", "analytics"),
    ("Quantcast", "Quantcast", "analytics"),
    ("HubSpot", "HubSpot", "analytics"),
    ("Klaviyo", "Klaviyo", "analytics"),
    ("Marketo", "Marketo", "analytics"),
    ("Salesforce", "Salesforce", "analytics"),
    ("Pardot", "Pardot", "analytics"),
    ("Mailchimp", "Mailchimp", "analytics"),
    ("Intercom", "Intercom", "analytics"),
    ("Drift", "Drift", "analytics"),
    ("Optimizely", "Optimizely", "analytics"),
    ("VWO", "VWO", "analytics"),
    ("Crazy Egg", "Crazy Egg", "analytics"),
    ("Wunderkind", "Wunderkind", "analytics"),
    ("Iterable", "Iterable", "analytics"),
    ("Braze", "Braze", "analytics"),
    ("OneTrust", "OneTrust", "analytics"),
    ("Meta Pixel", "Meta Pixel", "analytics"),
    ("Facebook", "Meta", "analytics"),
    ("Twitter", "X (Twitter)", "analytics"),
    ("LinkedIn", "LinkedIn Insight", "analytics"),
    ("TikTok", "TikTok Pixel", "analytics"),
    ("Pinterest", "Pinterest Tag", "analytics"),
    ("Amazon Ads", "Amazon Ads", "analytics"),
    ("Criteo", "Criteo", "analytics"),
    ("Pubmatic", "PubMatic", "analytics"),
    ("Index Exchange", "Index Exchange", "analytics"),
    ("Rubicon Project", "Rubicon Project", "analytics"),
    ("OpenX", "OpenX", "analytics"),
    ("Integral Ad Science", "Integral Ad Science", "analytics"),
    ("GumGum", "GumGum", "analytics"),
    ("Conversant", "Conversant", "analytics"),
    ("Innovid", "Innovid", "analytics"),
    ("Zendesk", "Zendesk", "analytics"),
    ("Freshdesk", "Freshdesk", "analytics"),
    ("Tawk.to", "Tawk.to", "analytics"),
    ("Crisp", "Crisp", "analytics"),
    ("LiveChat", "LiveChat", "analytics"),
    ("Stripe", "Stripe", "ecommerce"),
    ("PayPal", "PayPal", "ecommerce"),
    ("Klarna", "Klarna", "ecommerce"),
    ("Affirm", "Affirm", "ecommerce"),
    ("Afterpay", "Afterpay", "ecommerce"),
    ("Adyen", "Adyen", "ecommerce"),
    ("Square", "Square", "ecommerce"),
    ("Recurly", "Recurly", "ecommerce"),
    ("piano", "Piano", "ecommerce"),
    ("Piano", "Piano", "ecommerce"),
    ("Shopify", "Shopify", "ecommerce"),
    ("Cloudflare", "Cloudflare", "cdn"),
    ("Akamai", "Akamai", "cdn"),
    ("Fastly", "Fastly", "cdn"),
    ("Amazon Web Services", "AWS", "cdn"),
    ("Amazon CloudFront", "CloudFront", "cdn"),
    ("Vercel", "Vercel", "cdn"),
    ("Netlify", "Netlify", "cdn"),
    ("JSDelivr CDN", "jsDelivr", "cdn"),
    ("jsDelivr", "jsDelivr", "cdn"),
    ("Unpkg", "unpkg", "cdn"),
    ("Bunny CDN", "Bunny.net", "cdn"),
    ("BunnyCDN", "Bunny.net", "cdn"),
    ("KeyCDN", "KeyCDN", "cdn"),
    ("Google Fonts", "Google Fonts", "media"),
    ("Adobe Fonts", "Adobe Fonts (Typekit)", "media"),
    ("Typekit", "Adobe Fonts (Typekit)", "media"),
    ("YouTube", "YouTube", "media"),
    ("Vimeo", "Vimeo", "media"),
    ("Wistia", "Wistia", "media"),
    ("Cloudinary", "Cloudinary", "media"),
    ("Imgix", "imgix", "media"),
    ("Spotify", "Spotify", "media"),
    ("Squarespace", "Squarespace", "builder"),
    ("Wix", "Wix", "builder"),
    ("Webflow", "Webflow", "builder"),
    ("WordPress", "WordPress", "cms"),
)
# fmt: on
