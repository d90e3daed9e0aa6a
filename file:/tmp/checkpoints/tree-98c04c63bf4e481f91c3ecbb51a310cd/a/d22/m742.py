x742