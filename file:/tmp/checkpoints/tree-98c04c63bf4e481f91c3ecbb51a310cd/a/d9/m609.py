x609