x507