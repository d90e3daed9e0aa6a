x562