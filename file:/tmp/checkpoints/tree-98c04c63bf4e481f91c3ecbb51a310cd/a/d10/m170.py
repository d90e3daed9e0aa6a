x170