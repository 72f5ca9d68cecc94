"""Part of casewise; see the README for what each module holds."""
