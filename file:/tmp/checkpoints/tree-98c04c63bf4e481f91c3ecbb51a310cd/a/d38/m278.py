x278