x691