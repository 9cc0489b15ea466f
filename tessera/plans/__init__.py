"""Options, and the planners that choose a plan from them."""
