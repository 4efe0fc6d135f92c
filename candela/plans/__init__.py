"""Multi-step plans: research rounds, finalisation, audits."""
