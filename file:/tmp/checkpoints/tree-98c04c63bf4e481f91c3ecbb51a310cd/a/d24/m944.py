x944