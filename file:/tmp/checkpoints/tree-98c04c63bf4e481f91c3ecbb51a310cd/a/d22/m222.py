x222