"""Vocabularies and parameters of the checkout analysis.

Operators never hard-code these values; they take a spec object whose
defaults reproduce the reference analysis.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the reference analysis) ----------------------
# Funnel steps, in order.
FUNNEL_STEPS = (
    "first_visit",
    "add_to_cart",
    "begin_checkout",
    "add_shipping_info",
    "add_payment_info",
    "purchase",
)
# Generic events removed before labelling.
NOISE_EVENTS = ("session_start", "first_visit", "user_engagement", "scroll")
# Page views kept and relabelled with their page title.
CHECKOUT_PAGES = ("Shopping Cart", "Payment Method", "Checkout Confirmation")
# Checkout steps that count as churn points and friction signals.
CHURN_STEPS = ("begin_checkout", "add_payment_info", "Payment Method", "add_shipping_info")
# Churn steps that belong to the payment.
PAYMENT_STEPS = ("Payment Method", "add_payment_info")
# Clean-path checkpoints: each must occur exactly once after checkout start.
CLEAN_CHECKPOINTS = ("add_shipping_info", "Payment Method", "add_payment_info")
# Further events of an online shop, as analytics exports name them: with the steps above, the labels that packed
# sequence keys know (others are carried as they are).
SHOP_EVENTS = ("view_item", "view_item_list", "select_item", "view_promotion", "select_promotion", "view_search_results",
               "add_to_cart", "remove_from_cart", "view_cart", "add_to_wishlist", "click", "refund")
# Browser / operating-system segment filter.
SEGMENT_BROWSERS = ("Chrome", "Safari")
SEGMENT_SYSTEMS = ("Macintosh", "Windows", "iOS", "Android")
# The page whose absence is measured (tracking-gap diagnostic).
INFORMATION_PAGE = "Checkout Your Information"
# Average order value used as the revenue multiplier.
REFERENCE_AOV = 66.54
# ---------------------------------------------------------------------------

PURCHASE = "purchase"
BEGIN_CHECKOUT = "begin_checkout"
PAGE_VIEW = "page_view"
ADD_SHIPPING = "add_shipping_info"
PAYMENT_PAGE = "Payment Method"
ADD_PAYMENT = "add_payment_info"

# Event history (operators.history): a user with more rows than this is
# split over several tasks.
HISTORY_SPLIT_ROWS = 1_000_000


@dataclass(frozen=True)
class SegmentSpec:
    """Browser x operating-system filter and the segment key columns."""

    browsers: tuple[str, ...] = SEGMENT_BROWSERS
    systems: tuple[str, ...] = SEGMENT_SYSTEMS
    keys: tuple[str, ...] = ("browser", "operating_system")


@dataclass(frozen=True)
class CheckoutSpec:
    noise: tuple[str, ...] = NOISE_EVENTS
    pages: tuple[str, ...] = CHECKOUT_PAGES
    churn_steps: tuple[str, ...] = CHURN_STEPS
    checkpoints: tuple[str, ...] = CLEAN_CHECKPOINTS
    payment_steps: tuple[str, ...] = PAYMENT_STEPS
    begin: str = BEGIN_CHECKOUT
    history: int = 5
    shop_events: tuple[str, ...] = SHOP_EVENTS

    @property
    def labels(self) -> tuple[str, ...]:
        """The labels that are known beforehand, each once."""
        return tuple(dict.fromkeys((*self.pages, *self.churn_steps, *self.checkpoints, *self.payment_steps, self.begin, PURCHASE,
                                    *self.shop_events)))


@dataclass(frozen=True)
class FunnelSpec:
    steps: tuple[str, ...] = FUNNEL_STEPS
    base: str = "first_visit"
    min_count: int = 1  # cells with count <= min_count are dropped
    segment: SegmentSpec = field(default_factory=SegmentSpec)


@dataclass(frozen=True)
class Defaults:
    checkout: CheckoutSpec = field(default_factory=CheckoutSpec)
    funnel: FunnelSpec = field(default_factory=FunnelSpec)
    segment: SegmentSpec = field(default_factory=SegmentSpec)
    aov: float = REFERENCE_AOV


DEFAULTS = Defaults()
