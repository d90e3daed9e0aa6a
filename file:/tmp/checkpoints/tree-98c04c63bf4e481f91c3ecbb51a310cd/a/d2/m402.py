x402