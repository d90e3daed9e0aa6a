x954